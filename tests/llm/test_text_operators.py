import base64
import hashlib
import json
import math
import random
import textwrap
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, language_id, license_scan, packing
from lodestone.llm.queries import OP3_SQL, op1_language_id, op2_packing, op3_license_scan
from tests.compare import same
from tests.llm import plain

ODD = [None, "", " \n ", "x", "a  b　c   d\u0085e", "Don't we'LL <|endoftext|> ½ ٣ 中文 é é", "é" * 3000 + " end " * 2000, "\U0001f600 ​﻿", "line\nline\r\nline"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], plain.TEXT)


# --- byte-level BPE ---


def tiktoken_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_ranks_and_decode_to_the_text(spark):
    tk = tiktoken_encoding()
    texts = [*ODD, *ODD]
    out = bpe.round_trip(docs(spark, texts), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = tk.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_random_texts_are_cut_safely():
    tk, enc = tiktoken_encoding(), bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    pool = [" ", "  ", "\n", " ", "　", "\x85", "\x1c", "'s", "'re", "a", "B", "é", "中", "1", "½", "!", "😀", " ", "\r\n", " ", "ſ"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc.encode([s.encode()])[0], "<u4").tolist() == tk.encode_ordinary(s)


def test_offsets_and_decoding_of_split_characters(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for t in ODD]
    out = bpe.decode_ids(bpe.encode_texts(docs(spark, ODD), tokenizer_path=path), tokenizer_path=path)
    table = bpe.token_bytes(path)
    split = 0
    for r in out.collect():
        text = texts[r["doc_id"]]
        assert bytes(r["decoded"]) == text.encode()
        for i, (a, b) in zip(r["ids"], r["token_offsets"], strict=True):
            assert table[i] in text[a:b].encode()
            split += table[i] != text[a:b].encode()
    assert split  # tokens of parts of characters were met
    assert bpe.encode_texts(docs(spark, []), tokenizer_path=path).count() == 0


# --- packing ---


def word_ids(text):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.encode_special_tokens = True
    return [*tk.encode(text or "", add_special_tokens=False).ids, 2]


def check_packed(rows, texts, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], list(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) > 0
    for i, t in enumerate(texts):
        at, ids = 0, []
        for start, part in sorted(pieces[i]):
            assert start == at
            ids += part
            at += len(part)
        assert ids == word_ids(t)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_keeps_every_id_and_pads_little(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choices(["alpha", "beta", "gamma", "1", "ß!"], k=rng.choice([0, 3, 40, 200, 700]))) for _ in range(60))]
    out = packing.pack_documents(docs(spark, texts).repartition(3), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), capacity=256)
    assert check_packed(out.collect(), texts, 256) == 0
    assert packing.pack_documents(docs(spark, []), tokenizer_path=public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_query_against_a_plain_form(spark, sf):
    """Every column of the query: ids by the tokenizers library alone, layout and padding by sequence."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_packing(spark, sf).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids, at = np.array([*tk.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # a power of two: no padding
        short += at < 4096
    partitions = len({s >> packing.PER_PARTITION for s in sequences})
    assert short <= 12 * partitions  # of each partition one for each smaller power of two at most


def test_packing_with_other_tokenizers_literals_and_odd_rows(spark, tmp_path):
    file = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    file["normalizer"] = {"type": "NFC"}  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(file))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert np.frombuffer(packing.WordEncoder(str(tmp_path / "other.json")).encode([b"Some TEXT"])[0], "<u4").tolist() == other.encode("Some TEXT", add_special_tokens=False).ids
    path, text = public_tokenizers.path("word_bpe_49k.json"), "a <|endoftext|> B<|startoftext|>"
    own = Tokenizer.from_file(path)
    assert np.frombuffer(packing.WordEncoder(path, special_literals=True).encode([text.encode()])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    assert 49407 not in np.frombuffer(packing.WordEncoder(path).encode([text.encode()])[0], "<u4")
    rows = spark.createDataFrame([(None, "a b", 7), (None, "a b", 7), (3, None, 8)], "doc_id long, text string, offset long")
    out = packing.pack_documents(rows, tokenizer_path=path, capacity=4, keep=("offset",)).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in out if r["start"] == 0) == [("3", 1), ("None", 3), ("None", 3)]


def test_packing_query_gives_the_plain_calls_ids(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|startoftext|>", "a <|ENDOFTEXT|> b", "plain"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert expected[0].tolist() == [320, 49407, 321, 2]
    rows = op2_packing(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(e) for i, e in expected.items()}
    assert all(r["ids_crc32"] == zlib.crc32(expected[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_subset_sum_is_the_best(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
    capacity = rng.randint(1, 90)
    reach = {0}
    for n, c in counts.items():
        reach = {r + k * n for r in reach for k in range(c + 1)}
    taken = packing.best_subset(counts, capacity)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == max(r for r in reach if r <= capacity)


def test_pieces_that_never_fill_a_window_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    out = []
    p = packing.Packer(64, 0, lambda *a: out.append(a))
    for i in range(500):
        p.add(i, np.arange(63, dtype="<u4"))
        assert len(p.waiting) <= 16
    p.pack(last=True)
    assert sum(len(a[2]) for a in out) == 500 * 63


# --- license scans ---


def test_phrases_and_blocks(spark):
    texts = [
        "The GNU General\nPublic   License, gnu general public license-x",
        "Licensed under the APACHE License, Version 2.0.\nmit licenses",
        "we say cc by, cc by. licensed under cc by nc 4 0 today",
        "Permission is hereby granted free of charge to any person obtaining a copy of that software",
        "glücc by einsmit license",
        None,
        "",
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, texts), keep=("doc_id",)).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert pick(0) == (10, 2, 1, 5, "gpl", "gpl")
    assert pick(1) == (10, 1, 3, 3, "apache", "apache,apache-2.0")
    assert pick(2) == (14, 3, 2, 8, "cc-by", "cc-by,cc-by-nc-4.0")
    assert pick(3) == (16, 0, None, None, "", "mit-grant")
    assert 0.9 <= got[3]["score"] < 1
    assert pick(4) == (4, 0, None, None, "", "")
    assert pick(5) == pick(6) == (0, 0, None, None, "", "")
    assert license_scan.scan_licenses(docs(spark, []), keep=("doc_id",)).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_join_is_exact(spark, threshold):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = {" ".join(rng.sample(vocabulary, rng.randint(1, 8))): f"t{i}" for i in range(8)}
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 10))) for _ in range(6)) for _ in range(40)]
    got = license_scan.scan_licenses(docs(spark, texts), templates=templates, threshold=threshold, keep=("doc_id",)).collect()
    for r in got:
        expected = set()
        for b, line in enumerate(texts[r["doc_id"]].split("\n")):
            block = plain.words(line)
            for t, label in templates.items():
                words = set(plain.words(t))
                most = max((len(words & set(block[i : i + 2 * len(words)])) for i in range(len(block))), default=0)
                if most and most >= threshold * len(words) - 1e-9:
                    expected.add((b, label, most / len(words)))
        assert {tuple(m) for m in r["matches"]} == expected


def test_words_scattered_over_a_line_are_no_match(spark):
    filler = lambda n: " ".join(f"x{i}" for i in range(n))
    apart = f"gnu {filler(300)} lesser {filler(300)} general {filler(300)} public {filler(300)} license"
    near = f"{filler(500)} the GNU (c) Lesser General Public License {filler(500)}"
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, [apart, near, apart.replace(" ", "\n")]), keep=("doc_id",)).collect()}
    assert [got[i]["labels"] for i in range(3)] == ["", "lgpl", ""]
    assert [got[i]["score"] for i in range(3)] == [0.0, 1.0, 0.0]


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    narrow = "x\ndnl " + "\ndnl ".join(mit.split())
    far = "Redistribution and use in source and binary forms\n" + "x " * 30 + "\nwith or without modification, are permitted"
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, [mit, bsd, mpl, narrow, far, mit.replace("\n", " ")]), keep=("doc_id",)).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["mit-grant", "bsd", "mpl-2.0", "mit-grant", "", "mit-grant"]
    assert [[tuple(w) for w in got[i]["wrapped"]] for i in range(3)] == [[(0, 1, "mit-grant", 1.0)], [(0, 1, "bsd", 1.0)], [(0, 1, "mpl-2.0", 1.0)]]
    assert [got[i]["score"] for i in range(6)] == [1.0, 1.0, 1.0, 1.0, 0.0, 1.0]
    assert not any(got[i]["matches"] for i in range(5)) and got[5]["matches"] and not got[5]["wrapped"]


def test_stretches_are_exact(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(20)]
    templates = {" ".join(rng.sample(vocabulary, rng.randint(2, 6))): f"t{i}" for i in range(6)}
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 4))) for _ in range(12)) for _ in range(30)]
    for r in license_scan.scan_licenses(docs(spark, texts), templates=templates, threshold=0.7, keep=("doc_id",)).collect():
        words = plain.words(texts[r["doc_id"]])
        line = [i for i, x in enumerate(texts[r["doc_id"]].split("\n")) for _ in plain.words(x)]
        for t, label in templates.items():
            own = set(plain.words(t))
            spans = [(i, j) for i in range(len(words)) for j in range(i + 2, min(len(words), i + 2 * len(own)) + 1) if line[i] != line[j - 1]]
            best = max((len(own & set(words[i:j])) for i, j in spans), default=0) / len(own)
            block = max((m["share"] for m in r["matches"] if m["label"] == label), default=0.0)
            share = [w["share"] for w in r["wrapped"] if w["label"] == label]
            assert share == ([best] if best >= 0.7 - 1e-9 and best > block else [])


def test_full_license_texts_are_found_wrapped_and_commented(spark):
    templates = license_scan.all_templates()
    texts = ["\n".join(f" * {x}" for x in textwrap.wrap(t, 72)) for t in templates]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(docs(spark, ["before\n" * 30 + t + "\nafter" * 30 for t in texts]), keep=("doc_id",)).collect()}
    assert all(label in got[i] for i, label in enumerate(templates.values()))


def test_license_sql_on_notices(spark, tmp_path):
    """The query against its SQL where every template stands, whole, wrapped and with words missing."""
    rng = random.Random(8)
    texts = [None, ""]
    for t in license_scan.all_templates():
        words = t.split()
        for share in (0.0, 0.05, 0.2):
            left = [w for w in words if rng.random() >= share]
            texts.append("\n".join(["x y z", *textwrap.wrap(" ".join(left), rng.choice([30, 72, 10_000])), "cc by"][: rng.randint(2, 40)]))
            texts.append(" ".join(w + " x" * rng.choice([0, 0, 1, 3]) for w in words))  # words further apart, in one line
    docs(spark, texts).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    files = tmp_path / "flat"
    files.mkdir()
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}), files / "documents.parquet")
    got = op3_license_scan(spark, str(tmp_path))
    same(got, OP3_SQL, str(files))
    assert got.where("labels <> ''").count() > 30


def test_phrases_take_linear_time():
    spaced = {b" cc by ": "cc-by", b" mit license ": "mit"}
    words = license_scan.words_of(b"cc by mit license " * 500_000)
    began = time.perf_counter()
    found = license_scan.phrase_places(words, spaced)
    assert time.perf_counter() - began < 20
    assert len(found) == 1_000_000
    assert found[:2] == [(0, "cc-by"), (4, "cc-by")]
    assert found[-1] == (1_999_998, "mit")


def test_license_columns_with_names_of_results(spark):
    rows = spark.createDataFrame([(None, "mit license", "old", 7.5), (1, None, None, None)], "doc_id long, text string, labels string, score double")
    got = sorted(((str(r["doc_id"]), r["labels"], r["score"]) for r in license_scan.scan_licenses(rows).collect()))
    assert got == [("1", "", 0.0), ("None", "mit", 1.0)]


# --- language ID ---

WORDS = {"aa": "kama tiko mana kima tako nami".split(), "bb": "stré plôx gréné brôt xplé snôr".split(), "cc": "zzyq wvvu qzzy uwvz yqqw vuzz".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def test_proportions_and_the_set_of_languages(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, 30), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, plain.TEXT))
    assert model.languages == ["aa", "bb", "cc"]
    texts = [sentence(rng, "aa", 40), sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 30), None, "", "12 34 !!", "kama", sentence(rng, "cc", 60_000), "ß"]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, texts), model).collect()}
    assert (got[0]["lang_pred"], got[0]["n_languages"], got[0]["score"]) == ("aa", 1, 1.0)
    assert (got[1]["lang_pred"], got[1]["n_languages"]) == ("aa", 2)
    assert got[1]["score"] == pytest.approx(2 / 3, abs=0.05)
    for i in (2, 3, 4):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[5]["lang_pred"] == "aa"
    assert got[6]["lang_pred"] == "cc"
    assert got[7]["lang_pred"] in WORDS


def test_nothing_to_learn_from(spark):
    empty = language_id.fit(docs(spark, []))
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, ["word"]), empty).collect()] == ["und"]
    assert language_id.identify(docs(spark, []), empty).count() == 0


def test_a_sample_is_enough(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 30), lang if i % 7 else None, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    df = spark.createDataFrame(rows, plain.TEXT)
    model = language_id.fit(df, per_language=10)
    assert language_id.identify(df, model).where("lang <> lang_pred").count() == 0


def test_held_out_accuracy(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = op1_language_id(spark, sf).join(docs_, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_slices_of_likelihoods_give_the_same_proportions(monkeypatch):
    rng = random.Random(6)
    model = language_id.Model(list("abcde"), np.log(np.random.default_rng(1).dirichlet(np.full(language_id.BUCKETS, 0.1), 5) + 1e-9).astype(np.float32))
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 40, 400]))).encode() for _ in range(30)]
    whole = language_id.proportions(texts, model)
    monkeypatch.setattr(language_id, "SLICE", 35)
    assert np.allclose(language_id.proportions(texts, model), whole, atol=1e-9)
    monkeypatch.setattr(language_id, "HELD", 0)
    assert np.allclose(language_id.proportions(texts, model), whole, atol=1e-9)


def test_a_long_text_in_many_languages_takes_bounded_memory():
    """2 MB in 64 languages, within 400 MB of arrays."""
    model = language_id.Model([f"l{i:02}" for i in range(64)], np.log(np.random.default_rng(2).random((64, language_id.BUCKETS), np.float32) + 0.01))
    text = b"word and others " * 131_072
    tracemalloc.start()
    try:
        share = language_id.proportions([text], model, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert share.sum() == pytest.approx(1)
    assert peak < 400e6


def test_language_ties_null_ids_and_clashing_columns(spark):
    rows = [(None, "kama tiko mana", "aa", "old", 7.0)] * 3 + [(1, "zzyq wvvu qzzy", "cc", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.fit(df, per_language=2)
    assert model.languages == ["aa", "cc"]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect())
    assert got == [("1", "cc", 1.0), *[("None", "aa", 1.0)] * 3, ("None", "und", 0.0)]
    same_twice = language_id.Model(["aa", "zz"], np.repeat(model.logp[:1], 2, axis=0))
    assert language_id.identify(df.where("lang = 'aa'"), same_twice).select("lang_pred").distinct().collect()[0][0] == "aa"
    with pytest.raises(ValueError, match="more than 1 languages"):
        language_id.fit(df, most_languages=1)


def plain_proportions(text, model, penalty=3.0, rounds=12):
    """The method word by word: expectation-maximisation over all languages, then over nested sets while the penalised likelihood grows."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
    words = bytes(map(fold, text.encode())).split()
    n = len(model.languages)
    if not words:
        return [0.0] * n
    lik = []
    for w in words:
        padded = b" " + w + b" "
        codes = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(w))]
        log = [sum(float(model.logp[k, c]) for c in codes) for k in range(n)]
        lik.append([math.exp(max(x - max(log), -60)) for x in log])

    def maximised(share):
        for _ in range(rounds):
            new = [0.0] * n
            for row in lik:
                total = sum(p * x for p, x in zip(share, row, strict=True))
                for k in range(n):
                    new[k] += row[k] * share[k] / total / len(lik)
            new = [max(x, 1e-9) * (share[k] > 0) for k, x in enumerate(new)]
            share = [x / sum(new) for x in new]
        return share, sum(math.log(sum(p * x for p, x in zip(share, row, strict=True))) for row in lik)

    share, _ = maximised([1 / n] * n)
    order = sorted(range(n), key=lambda k: -share[k])
    kept = [float(k == order[0]) for k in range(n)]
    value = sum(math.log(row[order[0]]) for row in lik)
    whole = maximised([1 / n] * n)[1]
    for size in range(2, n + 1):
        cost = penalty * math.log(len(words) + 1) * (size - 1)
        if whole - cost <= value:
            break
        got, log_lik = maximised([1 / size * (k in order[:size]) for k in range(n)])
        if log_lik - cost > value:
            kept, value = got, log_lik - cost
    return kept


def test_language_query_against_the_plain_method(spark, sf):
    """Predictions, scores and splits of the query for short texts of the table, and of mixtures of them."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet").where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in op1_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if 0 < len(r["text"] or "") < 1500][:25]
    for r in short:
        expected = plain_proportions(r["text"], model)
        mine = got[r["doc_id"]]
        if any(c.isalpha() for c in r["text"]):
            assert mine["score"] == pytest.approx(max(expected), abs=1e-4)
            assert mine["lang_pred"] == model.languages[max(range(len(expected)), key=expected.__getitem__)]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    by_lang = {r["lang"]: r["text"] for r in short if r["lang"]}
    mixture = "\n".join(by_lang.values())
    found = language_id.proportions([mixture.encode()], model)[0]
    assert found.tolist() == pytest.approx(plain_proportions(mixture, model), abs=1e-4)
    assert (found > 0).sum() >= 2
