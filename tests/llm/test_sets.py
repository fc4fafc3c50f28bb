"""The Jaccard join, LM scoring, packing, nearest neighbours, mixing and WARC against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from data import BASE, SCHEMA, SF, all_rows, clashing, documents, edges, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitlake.llm import lm_score, mixing, packing, parity_join, permutation_index, warc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    near = {(a, b) for ids in post.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def varied(spark):
    """Families of texts that differ by some words around the threshold, of sizes on both sides of the exact layouts."""
    rng, rows = np.random.default_rng(5), []
    for size in (12, 30, 61, 80, 140, 300, 900):
        for _ in range(6):
            text = [f"v{x}" for x in rng.integers(0, 10**9, size)]
            for cut in (0, 1, 2, 3, 5, 8, 13, 21, 34):
                out = list(text)
                for at in rng.choice(size, min(size, cut), replace=False):
                    out[at] = f"z{rng.integers(0, 10**9)}"
                rows.append((1_000_000 + len(rows), " ".join(out[: size - cut // 3]), "en", "web", 1))
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that many texts hold
    rows += [(2_000_000 + i, f"{shared} " + " ".join(f"q{x}" for x in rng.integers(0, 10**9, 60)), "en", "web", 1) for i in range(150)]
    rows += [(3_000_000 + i, shared + f" t{i % 4}", "en", "web", 1) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_jaccard_equals_brute_force(spark):
    rows = all_rows(spark).unionByName(clashing(varied(spark)))
    want = brute_components([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect() if r["doc_id"] is not None])
    got = parity_join.parity_join(rows).collect()
    assert len(got) == rows.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len({c for _, c in want.values()}) < len(want) - 100
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_jaccard_of_nothing(spark):
    assert parity_join.parity_join(empty(spark)).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in parity_join.parity_join(edges(spark).where("doc_id is not null")).collect()}
    assert by[-5] == by[-6] == by[-7] == -7 and by[-8] == by[-9] == -9 and by[-1] == -1 and by[-2] == -2


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (10, 500, 4000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)]))
        x, y = (parity_join.parity(s, 4096) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert (parity_join.folded(x, 512) == parity_join.parity(a, 512)).all()


def brute_scores(rows, target):
    texts = [(i, words(t)) for i, t in rows if i is not None]
    word, pair, start = ([Counter(), Counter()] for _ in range(3))
    for i, w in texts:
        for side in [1] + [0] * (i in target):
            word[side].update(w)
            pair[side].update(zip([None, *w], w, strict=False))
            start[side][None] += bool(w)
    n = [sum(c.values()) for c in word]
    distinct = min(len(word[1]), lm_score.VOCAB) + (len(word[1]) > lm_score.VOCAB)
    rate = [1.0, n[0] / n[1]]
    out = {}
    for i, w in texts:
        if w:
            for side in (0, 1):
                p = lambda b: (word[side][b] * rate[side] + 1) / (n[side] * rate[side] + distinct)  # noqa: B023, E731
                c = lambda a: (start[side][None] if a is None else word[side][a]) * rate[side]  # noqa: B023, E731
                loss = -sum(math.log((pair[side][a, b] * rate[side] + lm_score.MU * p(b)) / (c(a) + lm_score.MU)) for a, b in zip([None, *w], w, strict=False)) / len(w)
                out.setdefault(i, []).append(loss)
    return out


def test_lm_scores_equal_brute_force(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    rows = all_rows(spark)
    target = {r[0] for r in good.collect()}
    want = brute_scores([tuple(r) for r in rows.select("doc_id", "text").collect()], target)
    got = lm_score.score(rows, good).collect()
    assert len(got) == rows.count()
    for r in got:
        if r["doc_id"] in want:
            t, b = want[r["doc_id"]]
            assert r["xent_target"] == pytest.approx(t, abs=1e-9) and r["xent_background"] == pytest.approx(b, abs=1e-9) and r["xent_diff"] == pytest.approx(t - b, abs=1e-9)
        else:
            assert r["xent_diff"] is None
    assert lm_score.score(empty(spark), good).count() == 0
    assert lm_score.score(edges(spark), good.limit(0)).count() == edges(spark).count()


def test_lm_vocabulary_has_no_cap(spark):
    """70,000 words of equal count, more than 16 bits can name."""
    rng = np.random.default_rng(8)
    order = np.concatenate([rng.permutation(70_000) for _ in range(2)])
    rows = [(i, " ".join(f"v{x}" for x in part) + f" v{i} the end", "en", "web", 1) for i, part in enumerate(np.array_split(order, 60))]
    target = set(range(0, 60, 3))
    want = brute_scores([r[:2] for r in rows], target)
    got = lm_score.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert len({f"v{x}" for x in order}) > 65_535 and len(got) == len(rows)
    for r in got:
        assert (r["xent_target"], r["xent_background"]) == pytest.approx(tuple(want[r["doc_id"]]), abs=1e-9)


def test_lm_groups_are_bounded(spark, monkeypatch):
    """Words and pairs that are no large share of the corpus but more than a bucket holds."""
    monkeypatch.setattr(lm_score, "PAIRS_PER_BUCKET", 1000)
    monkeypatch.setattr(lm_score, "HOT_SHARE", 4)
    summed = lm_score._summed

    def watched(*given):
        run = summed(*given)

        def checked(pdf):
            if pdf["bucket"].iloc[0] >= 0 and sum(len(x) // 2 for x in pdf["places"]) > 3000:
                raise ValueError("a group is too large")
            return run(pdf)

        return checked

    monkeypatch.setattr(lm_score, "_summed", watched)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["x y"] * 200 + [f"u{a} h{b} h{c}" for a, b, c in rng.integers(0, (4000, 9, 9), (200, 3))]), "en", "web", 1) for i in range(40)]
    target = set(range(0, 40, 3))
    want = brute_scores([r[:2] for r in rows], target)
    got = lm_score.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["xent_target"], r["xent_background"]) == pytest.approx(tuple(want[r["doc_id"]]), abs=1e-9)


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = all_rows(spark)
    tok, docs = Tokenizer.from_file(path), defaultdict(list)
    for r in rows.select("doc_id", "text").collect():
        docs[r["doc_id"]].append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    got = packing.pack(rows, path).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        left = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own)
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        want = sorted((a, len(ids[a : a + 4096]), crc(ids[a : a + 4096]), len(ids)) for ids in docs[i] for a in range(0, len(ids), 4096))
        assert left == want, i
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    tokens = sum(len(x) for d in docs.values() for x in d)
    assert len(seqs) <= math.ceil(tokens / 4096 * 1.05) + 2
    assert packing.pack(empty(spark), path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(0, 64, 3000), minlength=64)
    plans = packing.cutting_stock(demand, 64)
    assert (sum(p * c for p, c in plans) == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plans)
    assert sum(c for _, c in plans) <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2


def test_nearest_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(10_000_020, None), (10_000_040, [0.0] * 4), (10_000_060, [float("nan")] * 4), (None, [1.0] * 4), (10_000_001, [None] * 4)], "vec_id long, embedding array<float>")
    got = permutation_index.search(rows.unionByName(odd).withColumn("block", F.lit(1)).withColumn("v", F.lit(2))).collect()
    data = rows.collect()
    ids, v = np.array([r["vec_id"] for r in data]), np.array([[float(x) for x in r["embedding"]] for r in data])
    at = {i: n for n, i in enumerate(ids)}
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(by) == sorted(asked)
    found = 0
    for q in asked:
        s = permutation_index.exact(np.repeat(v[at[q]][None], len(v), 0), v)
        s[at[q]] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(by[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(sc == pytest.approx(s[at[i]], abs=1e-12) for _, i, sc in own)
        assert [(-x, i) for _, i, x in own] == sorted((-x, i) for _, i, x in own)
        found += len({i for _, i, _ in own} & set(best.tolist()))
    assert found / (20 * len(asked)) >= 0.9
    assert permutation_index.search(rows.limit(0)).count() == 0
    # the same rows ten times over, moved a little: as good, on more than one block
    rng = np.random.default_rng(2)
    more = np.concatenate([v + rng.normal(0, 0.4 / 8, v.shape) * (i > 0) for i in range(10)])
    many = spark.createDataFrame([(i, x) for i, x in enumerate(more.tolist())], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(i, more[i].tolist()) for i in range(0, len(more), 400)], "vec_id long, embedding array<double>")
    by = defaultdict(set)
    for r in permutation_index.search(many, some).collect():
        by[r["query_id"]].add(r["vec_id"])
    hits = [len(by[i] & {j for j in np.argsort(-(more @ more[i]), kind="stable")[:21].tolist() if j != i}) / 20 for i in range(0, len(more), 400)]
    assert len(many.collect()) > 2 * permutation_index.BLOCK and np.mean(hits) >= 0.9
    # ties, equal vectors, ids that occur twice
    tied = spark.createDataFrame([(20, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (20, [2.0, 2.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["score"], r["vec_id"]) for r in permutation_index.search(tied, k=3).collect())
    assert got == [(2.0, 1), (2.0, 2), (2.0, 3)]
    few = permutation_index.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(few)] == [(1, 1, 1.0), (2, 2, 0.5)]


def test_mixing_meets_the_marginals(spark):
    got = mixing.mix(all_rows(spark))
    assert got.count() == all_rows(spark).count()
    rows = got.select("doc_id", "source", "text", "mix_source", "mix_lang", "mix_topic", "mix_words", "mix_weight", "mix_p", "mix_kept").collect()
    total = sum(r["mix_words"] for r in rows)
    mass = sum(r["mix_words"] * (r["mix_weight"] or 0) for r in rows)
    for key in mixing.KEYS:
        have, share = Counter(), Counter()
        for r in rows:
            have[r[key]] += r["mix_words"]
            share[r[key]] += r["mix_words"] * (r["mix_weight"] or 0) / mass
        want = {k: v**0.85 for k, v in have.items() if v}
        for k, w in want.items():
            assert share[k] == pytest.approx(w / sum(want.values()), rel=1e-4), (key, k)
    assert all(0 <= r["mix_p"] <= 1 and r["mix_words"] == len(words(r["text"])) for r in rows)
    expected = sum(r["mix_p"] * r["mix_words"] for r in rows)
    assert 0 < expected <= 0.6 * total * (1 + 1e-9)
    assert mixing.mix(empty(spark)).count() == 0
    again = {r["doc_id"]: r["mix_kept"] for r in mixing.mix(all_rows(spark).repartition(7)).collect() if r["doc_id"] is not None}
    assert again == {r["doc_id"]: r["mix_kept"] for r in rows if r["doc_id"] is not None}


def test_mixing_equals_plain_raking(spark, monkeypatch):
    """Weights, probabilities and the miss against raking in plain Python; by a broadcast of the cells and by a join."""
    rng = np.random.default_rng(3)
    texts = ["a b c", "x | y | z", "1. one two", "%%% so", "", None]
    rows = [(i, texts[rng.integers(0, 6)], ["en", "de", None][rng.integers(0, 3)], ["web", "books", "code"][min(2, rng.geometric(0.6) - 1)], 1) for i in range(400)]
    for sent in (mixing.SENT_CELLS, 3):
        monkeypatch.setattr(mixing, "SENT_CELLS", sent)
        got = mixing.mix(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
        cells = Counter()
        for r in got:
            cells[tuple(r[k] for k in mixing.KEYS)] += r["mix_words"]
        w = {c: float(n) for c, n in cells.items() if n}
        goal = []
        for i in range(3):
            have = Counter()
            for c, n in w.items():
                have[c[i]] += n
            goal.append({v: n**0.85 / sum(x**0.85 for x in have.values()) for v, n in have.items()})
        for _ in range(500):
            for i in range(3):
                have = Counter()
                for c, n in w.items():
                    have[c[i]] += n
                w = {c: n * goal[i][c[i]] / have[c[i]] for c, n in w.items()}
        weight = {c: w[c] / cells[c] for c in w}
        scale = min(1 / max(weight.values()), 0.6 * sum(cells.values()) / sum(w.values()))
        for r in got:
            c = tuple(r[k] for k in mixing.KEYS)
            if c in weight:
                assert r["mix_weight"] == pytest.approx(weight[c], rel=1e-4) and r["mix_p"] == pytest.approx(min(1, weight[c] * scale), rel=1e-4) and r["mix_miss"] <= 1e-6
            else:
                assert r["mix_weight"] is None and r["mix_p"] == pytest.approx(min(1, scale), rel=1e-4)
    # targets that no weights meet: two cells only, whose shares are tied
    tied = spark.createDataFrame([(1, "a b", "en", "web", 1), (2, "a b", "de", "books", 1)], SCHEMA)
    share = lambda k, **x: spark.createDataFrame(list(x.items()), f"{k} string, share double")
    odd = {"mix_source": share("mix_source", web=0.5, books=0.5), "mix_lang": share("mix_lang", en=0.9, de=0.1), "mix_topic": share("mix_topic", prose=1.0)}
    assert all(r["mix_miss"] > 0.1 for r in mixing.mix(tied, targets=odd).collect())


def test_warc_files_and_repeated_ids(spark, tmp_path):
    made = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 50, None) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(made[0] + b"broken" + made[1])
    (tmp_path / "b.warc.gz").write_bytes(warc.member(made[2]) + warc.member(made[3]))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in got if r["kind"] == "record") == [0, 1, 2, 3] and sum(r["kind"] == "gap" for r in got) == 1
    long = "x" * 3_000_000
    pages = spark.createDataFrame([(5, "u", "same"), (5, "u", "same"), (2, "u", "same"), (9, "u", long), (8, "u", long)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.round_trip(pages).where("kind = 'record'").collect())
    assert got == [(2, "revisit", 5, 4), (5, "response", 0, 4), (5, "response", 0, 4), (8, "revisit", 9, 3_000_000), (9, "response", 0, 3_000_000)]


def test_large_branches_of_the_join_and_the_scores(spark, monkeypatch):
    """Joins instead of broadcasts, frequent keys apart from buckets, several blocks a hub, wider keys: the same results."""
    rows = varied(spark).select("doc_id", "text")
    rows = rows.unionByName(rows.limit(50))  # rows that share id and text
    want = brute_components([(r["doc_id"], r["text"]) for r in rows.collect()])
    monkeypatch.setattr(parity_join, "SENT_IDS", 1)
    monkeypatch.setattr(parity_join, "KEYS_PER_BUCKET", 200)
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    got = parity_join.parity_join(rows).collect()
    assert len(got) == rows.count() and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    monkeypatch.setattr(lm_score, "SENT_IDS", 1)
    target = set(range(1_000_000, 1_000_400, 3))
    few = spark.createDataFrame([(i,) for i in target], "doc_id long")
    want = brute_scores([(r["doc_id"], r["text"]) for r in varied(spark).collect()], target)
    for r in lm_score.score(varied(spark), few).collect():
        assert (r["xent_target"], r["xent_background"]) == pytest.approx(tuple(want[r["doc_id"]]), abs=1e-9)


def test_warc_round_trip(spark):
    extra = [(None, None, None), (-1, "u\r\nWARC/1.1\r\n", None), (-2, None, ""), (-3, "x", "WARC/1.1\r\n\r\n é"), (-4, "x", "WARC/1.1\r\n\r\n é")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")).withColumn("key", F.lit(1)).withColumn("keeper", F.lit(2))
    keep = {}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    for i, p in rows:
        if i is not None:
            keep[p] = max(keep.get(p, i), i)
    want = sorted((str(i), len(p), warc.digest_of(p), "response" if i is None or keep[p] == i else "revisit", str(None if i is None or keep[p] == i else keep[p])) for i, p in rows)
    got = warc.round_trip(pages).where("kind = 'record'").collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == want
    assert warc.round_trip(pages).where("kind = 'gap'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    made = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 50, None) for i in range(6)]
    parts = [warc.member(r) for r in made] if zipped else made
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0x55
    data = b"".join([parts[0], parts[1], bytes(bad), b"junk" * 9, parts[3], parts[4][:-40], parts[5]])
    rows = list(warc.salvage("a", data))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 1, 3, 5]
    gaps = [(r["offset"], r["length"]) for r in rows if r["kind"] == "gap"]
    first = len(parts[0]) + len(parts[1])
    assert gaps == [(first, len(bad) + 36), (first + len(bad) + 36 + len(parts[3]), len(parts[4]) - 40)]
    assert [r["page_id"] for r in warc.salvage("b", b"".join(parts)[: -len(parts[5]) // 2]) if r["kind"] == "record"] == [0, 1, 2, 3, 4]
    assert list(warc.salvage("c", b"")) == [] and BASE and documents and edges


def test_warc_salvage_keeps_what_can_be_read():
    ids = lambda data: [r["page_id"] for r in warc.salvage("a", data) if r["kind"] == "record"]
    rng = np.random.default_rng(4)
    made = [warc.record(i, "u", rng.bytes(5000).hex().encode(), None) for i in range(8)]
    # a plain archive whose first version line is damaged, alone and before gzip members
    assert ids(b"X" + b"".join(made)[1:]) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(b"X" + made[0][1:] + made[1] + warc.member(made[2]) + made[3]) == [1, 2, 3]
    # one member of many records: a bad one, a cut, damage
    bad = bytearray(b"".join(made))
    bad[len(made[0]) * 3 + 6000] ^= 1
    rows = list(warc.salvage("a", warc.member(bytes(bad))))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 1, 2, 4, 5, 6, 7] and sum(r["kind"] == "gap" for r in rows) == 1
    whole = warc.member(b"".join(made))
    cut = list(warc.salvage("a", whole[: len(whole) // 2]))
    assert [r["page_id"] for r in cut if r["kind"] == "record"] == [0, 1, 2] and cut[-1]["kind"] == "gap"
    hurt = bytearray(whole)
    hurt[len(whole) // 2 : len(whole) // 2 + 40] = bytes(40)
    assert ids(bytes(hurt) + warc.member(made[7]))[:3] == [0, 1, 2] and ids(bytes(hurt) + warc.member(made[7]))[-1] == 7
    # other digests and other types
    other = re.sub(rb"sha1:\w+", b"md5:00", made[0])
    assert ids(other + made[1]) == [0, 1]
    hexed = made[0].replace(warc.digest_of(made[0].partition(b"\r\n\r\n")[2][:-4]).encode(), b"0" * 40)
    assert ids(hexed + made[1]) == [1]
    info = list(warc.salvage("a", b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"))
    assert [(r["record_type"], r["payload"], r["payload_bytes"]) for r in info] == [("warcinfo", b"hello", 5)]
