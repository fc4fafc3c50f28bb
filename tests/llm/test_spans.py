"""Winnowing, fill-in-middle and periodic runs against DuckDB or plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from data import EDGES, SCHEMA, SF, all_rows, clashing, documents, edges, empty

from orbitlake.llm import fim, periodic, winnowing

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def contaminated(docs, items, window=10):
    """(n_words, hit places, items) of each text, by trying every window at every place."""
    cut = lambda ws, n: [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    held = {}
    for item, text in items:
        ws = WORD.findall(lower_az(text))
        for win in cut(ws, min(window, len(ws))) if ws else []:
            held.setdefault(win, set()).add(item)
    out = []
    for text in docs:
        ws, places, found = WORD.findall(lower_az(text)), set(), set()
        for n in {len(w) for w in held}:
            for i, win in enumerate(cut(ws, n)):
                if win in held:
                    places |= set(range(i, i + n))
                    found |= {str(x) for x in held[win] if x is not None}
        out.append((len(ws), places, sorted(found)))
    return out


def spans_of(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def check_winnowing(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in winnowing.decontaminate(clashing(d), b, **options).collect()}
    for i, (n, places, found) in enumerate(contaminated(docs, items, **options)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"], r["contaminated"]) == (n, len(places), spans_of(places), found, bool(places))


def test_winnowing_equals_every_window(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "Été", "ÀB", "x1", "42"] + [f"w{i}" for i in range(40)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 2, 3, 5, 7, 8, 9, 10, 11, 14, 30])) if i > 3 else some(20))) for i in range(25)]
    items += [(3, items[3][1]), (77, items[4][1]), (None, "only by null " * 4), (78, None), (79, " .. "), (80, "A-B,c d.E f g h i;j"), (5, "other text of an id that stands twice, and long enough")]
    docs = [None, "", "..", "a b c d e f g h i j k", "ONLY by null only BY null only by null only by"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += some(rng.randint(0, 12))
            ws = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(ws) - 1))
            parts += ws[a : a + rng.randint(6, 14)]
        docs.append((" " if rng.random() < 0.5 else ", ").join(parts).upper())
    check_winnowing(spark, docs, items)
    check_winnowing(spark, docs, items, window=4)
    check_winnowing(spark, docs[:3], [(1, "a b c")], window=1)
    check_winnowing(spark, docs[:6], [])


def test_winnowing_of_copies_and_common_passages(spark):
    """Many documents and items with one passage: equal texts are one group, and a list of items is made once."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"item{i} {passage} end{i}") for i in range(60)]
    docs = [f"a {passage} b"] * 200 + [f"{i} {passage}" for i in range(100)] + [f"item7 {passage}"] + ["p1 p2 p3 p4 p5 p6 p7 p8 p9 x p10"]
    check_winnowing(spark, docs, items)


def test_winnowing_equals_sql(spark, tmp_path):
    documents(spark).unionByName(edges(spark)).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet' UNION ALL SELECT -1, 'three four FIVE'")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.sql("SELECT -1L AS item_id, 'three four FIVE' AS text"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted(map(key, map(tuple, winnowing.digest(winnowing.decontaminate(all_rows(spark), bench)).collect())))
    assert got == sorted(map(key, con.execute(winnowing.sql()).fetchall()))
    assert winnowing.decontaminate(empty(spark), bench).count() == 0


def test_fingerprints_are_minima(spark):
    row = spark.sql("SELECT transform(sequence(1, 40), x -> xxhash64(x % 7, x % 5)) AS h").select("h", *[winnowing.fingerprints(winnowing.F.col("h"), n).alias(f"f{n}") for n in (1, 2, 7, 8, 10, 41)]).first()
    assert row["f1"] == row["h"] and len(row["f10"]) == 31 and row["f41"] == [] and len(row["f7"]) == 34 and len(row["f8"]) == 33
    grams = spark.sql("SELECT transform(sequence(1, 40), x -> xxhash64(x % 7, x % 5)) AS h").select(winnowing._doubled(winnowing.F.col("h"), 8, lambda a, b: winnowing.F.xxhash64(a, b)).alias("g")).first()["g"]
    assert row["f10"] == [min(grams[i : i + 3]) for i in range(31)]


def moved(doc_id, text):
    """The contract in plain Python: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if doc_id is None or not text or any(x in text for x in fim.SENTINELS):
        return len(units), "plain", None, None, text
    d = SHA(f"7:{doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 50 else (len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


FIM_TEXTS = ["", "\n", "\n\n\n", "a\nb", "é\n😀€\nü", "x <P> y\nz", "<P", ">", "< P>", "<<S>", "<M", "a<\nP>\nb", "<\n<S\n>M>", "é\r\n x\n", "z" * 70_000 + "\né\n" * 3, None, *["l%d é\n" % i * i for i in range(40)]]


def test_fim_equals_the_contract(spark):
    rows = [(i, t, "en", "web", 1) for i, t in enumerate(FIM_TEXTS * 3)] + EDGES
    rows += [(r["doc_id"], r["text"], None, None, 0) for r in documents(spark).collect()]
    got = fim.transform(clashing(spark.createDataFrame(rows, SCHEMA)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got.collect()))) == sorted(key((r[0], *moved(r[0], r[1]))) for r in rows)
    back = fim.digest(got).collect()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in back) == sorted((str(r[0]), SHA(r[1] or "")) for r in rows)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"} and fim.transform(empty(spark)).count() == 0
    texts = {i: t for i, t, *_ in rows[: len(FIM_TEXTS)]}
    few = fim.transform(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["chars"] == len(texts[r["doc_id"]] or "") for r in few) and sum(r["sentinels"] for r in few) == 2


def test_fim_parameters(spark):
    rows = spark.createDataFrame([(i, "a\nb\nc\n[MID]" if i % 10 == 0 else "a\nb\nc\n<P>") for i in range(400)], "k long, body string")
    got = fim.transform(rows, rate=50, spm=0, sentinels=("[PRE]", "[SUF]", "[MID]"), id_col="k", text_col="body").collect()
    assert {r["form"] for r in got} == {"plain", "psm"} and all(r["form"] == "plain" for r in got if r["doc_id"] % 10 == 0)
    assert 120 < sum(r["form"] == "psm" for r in got) < 240
    with pytest.raises(ValueError):
        fim.Automaton(("<P>", "", "x"))


def test_dfa_of_any_row_width():
    """The tables, read in rows, say what reading byte by byte says, at every cut between rows."""
    rng = random.Random(1)
    auto = fim.Automaton()
    for n in (1, 5, 63, 64, 65, 130, 4097):
        data = "".join(rng.choice(["<P>", "<", "P", "S>", "é", "😀", "\n", "a", "<<M>"]) for _ in range(n)).encode()[:n]
        state, want = 0, []
        for byte in data:
            want.append(auto.kind[state + byte])
            state = auto.next[state + byte]
        got = auto.kinds(np.frombuffer(data, np.uint8))
        assert got.tolist() == want
        assert (got & fim.SENTINEL > 0).sum() == len(re.findall(b"<[PSM]>", data)) and (got & fim.CHAR).sum() == sum(b & 0xC0 != 0x80 for b in data)


def test_fim_equals_sql(spark, tmp_path):
    documents(spark).unionByName(edges(spark)).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(key, map(tuple, fim.digest(fim.transform(all_rows(spark))).collect()))) == sorted(map(key, con.execute(fim.sql()).fetchall()))


def all_runs(w, exponent=4, shortest=6):
    """(start, length, period) by trying every period."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(shortest, exponent * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_every_period():
    rng = random.Random(11)
    texts = []
    for _ in range(1200):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
        if len(w) > 8 and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randint(1, 7)
            w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i in range(len(w))]
        texts.append(w)
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    texts += [b, [0] * 500, [0, 1] * 200, ([0] * 6 + [1]) * 30, list(range(50)) * 9, []]
    counts = np.array([len(t) for t in texts])
    for exponent, shortest in ((4, 6), (2, 1), (2.5, 5), (3, 3)):
        of, start, length, period = periodic.runs_of_texts(np.array(sum(texts, []), np.int64), counts, exponent, shortest)
        got = list(zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True))
        assert got == [(i, *r) for i, t in enumerate(texts) for r in all_runs(t, exponent, shortest)]


def test_squares_cover_leftmost_ones():
    """Pairs from block borders cover the leftmost occurrence of every square; walks and leaves find all others."""
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        s = periodic.Substrings(np.array([*w, 99]))
        pairs = set(zip(*map(np.ndarray.tolist, periodic._covering(s)), strict=True))
        first = {}
        for i in range(len(w)):
            for k in range(1, (len(w) - i) // 2 + 1):
                if w[i : i + k] == w[i + k : i + 2 * k]:
                    first.setdefault(tuple(w[i : i + 2 * k]), (i, k))
        for i, k in first.values():
            begin = i
            while (begin, k) not in pairs:
                begin -= 1
                assert begin >= 0 and w[begin] == w[begin + k]
        assert all(w[i : i + k] == w[i + k : i + 2 * k] for i, k in pairs)


def periodic_row(doc_id, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w) if n < 3000 else None
    if found is None:
        return None
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        SHA("".join(f"{s},{m},{q}\n" for s, m, q in found)), SHA(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_periodic_equals_every_period(spark):
    rows = [(r["doc_id"], r["text"], None, None, 0) for r in documents(spark).collect()] + EDGES
    rows += [(100_000 + i, " ".join([*"xy"] * (i % 9) + ["a", "b c"] * (i % 13) + ["end"] * (i % 7)), "en", "web", 1) for i in range(300)]
    got = {}
    for r in periodic.digest(periodic.find(periodic.planted(clashing(spark.createDataFrame(rows, SCHEMA))))).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        want = periodic_row(doc_id, text)
        assert want is None or want in got[doc_id]
    assert any(r[1] for rs in got.values() for r in rs)


def test_periodic_of_arrays(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array('a', 'b', 'a', 'b', 'a', 'b', 'c')), (2, array()), (3, NULL) AS t(k, tokens)")
    got = {r["doc_id"]: r for r in periodic.find(df, exponent=3, shortest=6, id_col="k", words_col="tokens").collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 6, 2)] and got[1]["collapsed"] == "a b c" and tuple(got[1]["best"]) == (0, 6, 2)
    assert got[2]["runs"] == [] == got[3]["runs"] and got[2]["collapsed"] == "" and got[3]["best"] is None and got[3]["n"] == 0
    assert periodic.digest(periodic.find(periodic.planted(empty(spark)))).count() == 0
    with pytest.raises(ValueError):
        periodic.find(df, exponent=1.5)
