"""License scans, personal data, language ID and media against plain Python or DuckDB."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
from data import SF, all_rows, documents, edges, empty
from pyspark.sql import functions as F

from orbitlake.llm import langid, license_scan, media, pii, queries


def test_license_equals_sql(spark, tmp_path):
    rows = documents(spark).unionByName(edges(spark))
    rows.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    key = lambda r: tuple((x is None, str(x)) if not isinstance(x, float) else (False, f"{x:.9f}") for x in r)
    want = sorted(map(key, con.execute(license_scan.sql()).fetchall()))
    got = sorted(map(key, map(tuple, license_scan.scan(all_rows(spark)).collect())))
    assert got == want
    assert license_scan.scan(empty(spark)).count() == 0
    by = {r["doc_id"]: r for r in license_scan.scan(edges(spark)).collect() if r["doc_id"]}
    assert by[-13]["base_labels"] == "cc-by,gpl,reserved" and by[-13]["n_base"] == 5 and "t-gpl" in by[-13]["labels"]
    assert by[-14]["labels"] == "t-mit,t-public" and by[-1]["n_words"] == 0


def test_license_blocks_cross_lines_and_are_bounded(spark):
    filler = " ".join(f"w{i}" for i in range(400))
    mit = license_scan.TEMPLATES["t-mit-text"].split()
    texts = [
        "Redistribution and use in source and binary forms,\nwith or without\nmodification, are permitted",
        # all words of a template, but far apart
        filler.join(["released ", " under ", " the mit ", " license"]) + " this " + filler + " work is in the " + filler + " public domain",
        filler + " " + "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9)).upper() + " " + filler,
        " ".join(w if i % 9 else "changed" for i, w in enumerate(mit)),
        "released under the apache license",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(5)) AS doc_id, unnest($1) AS text", [texts])
    want = {r[0]: r for r in con.execute(license_scan.sql()).fetchall()}
    assert {i: tuple(r) for i, r in by.items()} == want
    assert by[0]["labels"] == "t-bsd" and by[1]["labels"] == "" and by[1]["score"] == 0 and by[2]["labels"] == "t-mit-text" and by[4]["labels"] == ""


def luhn(d):
    return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, ok in rules:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def test_pii_base_spans_and_redaction(spark, tmp_path):
    rows = all_rows(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect() if r["doc_id"] is not None}
    got = {r["doc_id"]: r for r in queries.pii_query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1
    for i, text in texts.items():
        want = base_spans(text)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (i, said, got[i]["spans"])
        assert set(said.split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in want) for k in pii.KINDS[:4]]
    clean = pii.redact(edges(spark))
    assert clean.columns == edges(spark).columns
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "[EMAIL]" in by[-11] and " 10.0.0.1 " not in by[-11] and by[-12].startswith("[CARD] and 4111-1111-1111-1112 ")
    assert by[-1] is None and by[-2] == "" and by[-8] == "a b c"
    assert pii.find(empty(spark)).count() == 0


def test_pii_model_finds_held_out_shapes(spark):
    """Rows of another seed; other shapes, words and lengths than the training table's."""
    table = pii.training_rows(spark, 1200, seed=99).selectExpr("label", "concat(before, m, after, ' end') AS text")
    found = pii.find(table).selectExpr("label", "size(pii_base) + size(pii_added) > 0 AS hit").groupBy("label").agg(F.avg(F.col("hit").cast("double")).alias("rate")).collect()
    rate = {r["label"]: r["rate"] for r in found}
    assert rate[1.0] > 0.8 and rate[0.0] < 0.2, rate
    rng = np.random.default_rng(12)
    hexed = lambda n: rng.bytes(n).hex()[:n]
    rows = [(1, f'set auth_token = "{hexed(40)}" here') for _ in range(20)] + [(1, f"login password={hexed(18)} das") for _ in range(20)]
    rows += [(1, f"ring ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)} now") for _ in range(20)]
    rows += [(0, f"it was {rng.integers(1900, 2020)}-{rng.integers(10, 12)}-{rng.integers(10, 28)} in the world-wide-news-paper{i}") for i in range(40)]
    found = pii.find(spark.createDataFrame(rows, "label int, text string")).selectExpr("label", "size(pii_base) + size(pii_added) > 0 AS hit").collect()
    assert np.mean([r["hit"] for r in found if r["label"]]) > 0.9 and np.mean([r["hit"] for r in found if not r["label"]]) < 0.1


def test_pii_trees_use_many_features(spark):
    score, least = pii.fitted(spark)
    used = set(re.findall(r"f\.(\w+) <=", score))
    assert len(used) >= 5 and set(least) >= {"number", "secret"}, used


def test_pii_of_very_many_matches_takes_linear_time(spark):
    import time

    def took(n):
        text = " ".join(f"a{i}@b.example 10.0.{i % 256}.1 +49 151 {10_000_000 + i} key=abcdef0123{i:08d}" for i in range(n))
        began = time.time()
        row = pii.redact(spark.createDataFrame([(text,)], "text string")).first()
        assert row["text"].count("[EMAIL]") == row["text"].count("[IP]") == n and "@" not in row["text"]
        return time.time() - began

    took(10)
    few, many = took(3_000), took(30_000)
    assert many < 25 * few + 5, (few, many)


def test_language_held_out_accuracy(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    d.createOrReplaceTempView("d")
    got = queries.language_query(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == d.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    held = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_edges(spark):
    model = langid.fit(documents(spark))
    by = {r["doc_id"]: r for r in langid.identify(all_rows(spark), model, ["doc_id"]).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (-1, -2, -3, -4)) and by[-10]["lang_pred"] != "und"
    assert by[-5]["lang_pred"] == by[-6]["lang_pred"]
    nothing = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(edges(spark), nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty(spark), model, ["doc_id"]).count() == 0


def test_media_round_trip(spark):
    texts = [r["text"] for r in all_rows(spark).select("text").collect()]
    want = {}
    for t in texts:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[hashlib.sha256(p).hexdigest()] = (len(b), len(p), zlib.crc32(p[-64:]))
    got = media.digest(all_rows(spark)).collect()
    assert len(got) == len(texts)
    assert {r["payload_sha256"]: (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in got} == want
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in got}) == len(want)
    full = media.encode(edges(spark)).where("doc_id = -10").first()
    assert media.from_wav(bytes(full["media"])) == media.padded(next(t for t in texts if t and len(t) > 300_000).encode())
    assert len(full["landmarks"]) == len(full["times"]) > 0
    assert media.digest(empty(spark)).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(256 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * 30 / 256 * t)).astype(np.uint8)
    when, which = media.peaks(tone)
    assert set(which[(which >= 20) & (which < 52)].tolist()) == {30} and when.max() == 19
    assert SF


def test_landmarks_are_all_pairs_and_meet_at_other_offsets():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    code, time = media.fingerprint(passage)
    moved, _ = media.fingerprint(np.concatenate([rng.integers(97, 123, 128).astype(np.uint8), passage]))
    assert len(np.intersect1d(code, moved)) > 0.9 * len(np.unique(code))
    t, b = media.peaks(passage, media.HOP)
    want = sorted((y << 16 | w << 8 | z - x, x) for i, (x, y) in enumerate(zip(t.tolist(), b.tolist(), strict=True)) for z, w in zip(t[i:].tolist(), b[i:].tolist(), strict=True) if 1 <= z - x <= media.REACH)
    assert sorted(zip(code.tolist(), time.tolist(), strict=True)) == want
    near, _ = media.fingerprint(np.concatenate([rng.integers(97, 123, 100).astype(np.uint8), passage]))
    other, _ = media.fingerprint(rng.integers(97, 123, 20_000).astype(np.uint8))
    assert len(np.intersect1d(code, near)) > 1.5 * len(np.intersect1d(code, other))
