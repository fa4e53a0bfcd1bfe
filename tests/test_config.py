import pytest

from lodestone.config import Settings, load_values, save_values, settings_for


def test_values_come_back(tmp_path):
    values = {"имя": "Ёж", "n": 3, "x": 0.5, "on": True, "none": None}
    save_values(values, tmp_path / "d/s.json")
    assert load_values(tmp_path / "d/s.json") == values
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["s.json"]


@pytest.mark.parametrize("text", ["{", "[]", '{"version": 2, "values": {}}', '{"version": 1, "values": []}'])
def test_other_files_give_nothing(tmp_path, text):
    (tmp_path / "s.json").write_text(text)
    assert load_values(tmp_path / "s.json") == {}
    assert load_values(tmp_path / "missing.json") == {}


def test_presets_and_ranges():
    s = settings_for("strict", "maximum", match_threshold="0,5", detector_threshold=0.05)
    assert (s.min_side, s.tile_size, s.match_threshold, s.rescue_threshold) == (65, 1000, 0.5, 0.05)
    with pytest.raises(ValueError, match="must be from"):
        settings_for(match_threshold=2)
    with pytest.raises(ValueError, match="not a number"):
        settings_for(match_threshold="x")
    assert Settings().anchor_limit == pytest.approx(0.34)
