"""Each operator against brute force or an exact round trip, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from urllib.parse import unquote, urlsplit

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terrascape.llm import graphs, llr, minhash, mixing, packing, prefixjoin, quality, sharding, suffix, toxicity, warc
from terrascape.llm.queries import tokenizer_path
from terrascape.llm.textops import Texts, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, shard string, offset string, kept string, fingerprint string, copies string"
SPACE = " \t\n\x0b\x0c\r"
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def make(spark, rows):
    """documents with more columns, whose names operators use for their own."""
    return spark.createDataFrame([(i, t, "en", "s", None, "a", "b", "c", "d", "e", "f", "g") for i, t in rows], SCHEMA)


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


def awkward():
    rnd = random.Random(5)
    long = sentence(rnd, 30_000)
    copy = sentence(rnd, 120)
    return [(None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, copy), (6, copy), (7, copy), (8, "x" * 5_000), (9, "中" * 400), (10, "!!! ### $$$"), (-3, "negative id")]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    rows, passage = [], sentence(rnd, 60)
    for i in range(60):
        text = sentence(rnd, rnd.randrange(5, 150))
        if i % 4 == 0:
            text = text + "\n" + passage + "\n" + sentence(rnd, 5)
        rows.append((i, text))
    for i in range(60, 75):  # near copies of one, each further from it
        w = rows[3][1].split(" ")
        for k in range((i - 60) // 3):
            w[(k * 17) % len(w)] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(75, rows[10][1]), (76, rows[10][1]), (77, "na " * 300), (78, "na " * 300 + "end")]
    return rows


def brute_repeats(rows, length):
    seen = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("kind", ["corpus", "awkward"])
def test_suffix_dedup(spark, corpus, kind):
    rows = corpus if kind == "corpus" else awkward()
    got = suffix.deduplicated(make(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows, 200)


def test_suffix_dedup_splits_large_groups(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_TOGETHER", 3)
    got = suffix.deduplicated(make(spark, corpus), 80, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(corpus, 80)


def test_intervals_of_a_suffix_array():
    text = "banana"
    order = sorted(range(6), key=lambda i: text[i:])
    common = [next((k for k, (a, b) in enumerate(zip(text[i:], text[j:])) if a != b), min(6 - i, 6 - j)) for i, j in zip(order, order[1:])]
    assert set(suffix.intervals(np.array(common))) == {(3, 1, 2), (1, 0, 2), (2, 4, 5), (0, 0, 5)}


def brute_groups(before, after, length):
    """(left, right, members) of each string of left + right bytes that members share, and that no byte more on either side is shared by all of them."""
    out = set()
    for i in range(len(before)):
        for left in range(len(before[i]) + 1):
            for right in range(max(0, length - left), len(after[i]) + 1):
                same = [k for k in range(len(before)) if len(before[k]) >= left and len(after[k]) >= right and before[k][:left] == before[i][:left] and after[k][:right] == after[i][:right]]
                ends = lambda side, n: {side[k][n : n + 1] or (b"", k) for k in same}  # noqa: B023, E731
                if len(same) > 1 and len(ends(before, left)) > 1 and len(ends(after, right)) > 1:
                    out.add((left, right, tuple(same)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeats_are_the_maximal_groups(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(suffix, "MOST_EXPANDED", rnd.choice([1, 7, 100_000]))
    texts = [[bytes(rnd.choices(b"ab\0", k=rnd.choice([0, 2, 5, 6, 6, 6]))) for _ in range(2)] for _ in range(40)]
    group = np.array(sorted(rnd.choices(range(3), k=40)))
    pad = lambda k: np.array([list(t[k].ljust(6, b"\0")) for t in texts], np.uint8)
    size = lambda k: np.array([len(t[k]) for t in texts])
    got = {}
    for parts in suffix.repeats(group, pad(0), size(0), pad(1), size(1), 3):
        for repeat, at, left, right in zip(*map(np.ndarray.tolist, parts)):
            got.setdefault((repeat, left, right), []).append(at)
    groups = [(left, right, tuple(sorted(at))) for (_, left, right), at in got.items()]
    want = set()
    for g in range(3):
        mine = np.flatnonzero(group == g).tolist()
        want |= {(left, right, tuple(mine[k] for k in at)) for left, right, at in brute_groups([texts[k][0] for k in mine], [texts[k][1] for k in mine], 3)}
    assert len(groups) == len(set(groups)) and set(groups) == want


@pytest.mark.parametrize("kind", ["corpus", "awkward", "empty"])
def test_repeat_groups_have_all_occurrences(spark, corpus, kind):
    rows = {"corpus": corpus, "awkward": [r for r in awkward() if r[1]], "empty": []}[kind]
    found = suffix.repeat_groups(make(spark, rows), 80, 20).collect()
    told = {}
    for r in found:
        told.setdefault((r["repeat"], r["n_bytes"]), []).append((r["doc_id"], r["start"]))
    texts = [(d, t.encode()) for d, t in rows]
    covered = Counter()
    for (digest, n), spots in told.items():
        d, at = spots[0]
        string = next(b[at : at + n] for e, b in texts if e == d and hashlib.sha1(b[at : at + n]).hexdigest() == digest)
        every = Counter((e, i) for e, b in texts for i in range(len(b) - n + 1) if b[i : i + n] == string)
        assert n >= 80 and len(spots) > 1 and Counter(spots) == every
        covered.update({(e, i + k) for e, i in spots for k in range(n)})
    gone = Counter({d: 0 for d, _ in rows})
    for d, n, removed, _, _ in brute_repeats(rows, 80).elements():
        gone[d] = max(gone[d], removed)
    assert {d: len({i for e, i in covered if e == d}) for d in gone} == dict(gone)


def brute_classes(rows, n, t):
    t = Fraction(t)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = [x for x in "".join(" " if c in SPACE else c for c in (text or "").translate(lower)).split(" ") if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * t.denominator >= t.numerator * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,t", [(3, "0.9"), (5, "0.8"), (2, "0.5")])
def test_prefix_tree_join(spark, corpus, n, t):
    got = prefixjoin.classes(make(spark, corpus), n, t).collect()
    assert Counter(map(tuple, got)) == brute_classes(corpus, n, t)


def test_prefix_tree_join_on_awkward_rows(spark):
    rnd = random.Random(7)
    w = sentence(rnd, 100).split(" ")
    # 300 and 301 are linked only through texts without a doc_id
    far = [" ".join(w[:i] + [f"n{k}" for k in range(i, i + 5)] + w[i + 5 :]) for i in (0, 30)]
    both = " ".join([f"n{k}" for k in range(5)] + w[5:30] + [f"n{k}" for k in range(30, 35)] + w[35:])
    rows = awkward() + [(300, far[0]), (301, far[1]), (None, both), (None, both), (None, " ".join(w))]
    got = prefixjoin.classes(make(spark, rows), 5, "0.8").collect()
    assert Counter(map(tuple, got)) == brute_classes(rows, 5, "0.8")


def test_prefix_tree_join_splits_large_groups(spark, corpus, monkeypatch):
    monkeypatch.setattr(prefixjoin, "MOST_TOGETHER", 4)
    monkeypatch.setattr(prefixjoin, "MOST_SHINGLES", 500)
    monkeypatch.setattr(prefixjoin, "FREQUENT", 3)
    monkeypatch.setattr(prefixjoin, "COPIES_TOGETHER", 2)
    monkeypatch.setattr(graphs, "HUBS", 2)
    got = prefixjoin.classes(make(spark, corpus), 3, "0.8").collect()
    assert Counter(map(tuple, got)) == brute_classes(corpus, 3, "0.8")


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (500, 499)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 499: 499, 500: 499}


def test_trie_finds_what_all_pairs_find():
    rnd = random.Random(2)
    base = [rnd.randrange(1000) for _ in range(40)]
    sets = [np.unique(np.array([x if rnd.random() < 0.9 else rnd.randrange(1000) for x in base], np.uint64)) for _ in range(30)]
    t = Fraction("0.7")
    forest = graphs.Forest(len(sets))
    for i, j in prefixjoin.joined(sets, t, (np.unique(sets[0]), np.arange(len(np.unique(sets[0]))))):
        forest.join(i, j)
        assert len(np.intersect1d(sets[i], sets[j])) >= t * len(np.union1d(sets[i], sets[j]))
    for i in range(30):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= t * len(np.union1d(sets[i], sets[j])):
                assert forest.root(i) == forest.root(j)


def test_minhash_neighbours(spark, corpus):
    for rows in (corpus, [r for r in awkward() if r[0] is not None and r[0] != 6]):
        got = {r.doc_id: r for r in minhash.edited_neighbours(make(spark, rows), buckets=5).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        for i, (d, text) in enumerate(order):
            text, then = text or "", order[(i + 1) % len(order)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + then[:half]
            assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            a, b, c = (set(shingle_sets(Texts([x.encode()]).words(), 5)[0].tolist()) for x in (text, edited, then))
            for other, near in ((b, got[d].near_edited), (c, got[d].near_next)):
                exact = len(a & other) / len(a | other) if a | other else 1.0
                assert abs(near - exact) < 0.2
        prints = {t or "": got[d].fingerprint for d, t in rows}
        assert all(got[d].fingerprint == prints[t or ""] for d, t in rows)


def test_minhash_order_of_rows_without_doc_ids(spark):
    """Many nulls lie in ranges of their hashes; each row's next is the one that the order says, over all ranges."""
    rows = [(None, f"nameless text {i} of many") for i in range(150)] + [(i * 1000 - 9, f"named text {i}") for i in range(60)] + [((1 << 63) - 1, "last"), (-(1 << 63), None)]
    docs = make(spark, rows)
    got = minhash.edited_neighbours(docs, buckets=7).collect()
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).orderBy(F.desc_nulls_last("doc_id"), "tie").collect()
    want = []
    for i, r in enumerate(order):
        text, then = r.text or "", order[(i + 1) % len(order)].text or ""
        want.append((str(r.doc_id), hashlib.sha256((text[: len(text) - len(text) // 2] + then[: len(text) // 2]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)
    bounds = [-5, 0, 3, 3, 70]
    found = spark.range(-8, 80).select("id", minhash._place(bounds, F.col("id")).alias("n")).collect()
    assert [r.n for r in found] == [sum(b <= r.id for b in bounds) for r in found]


def test_minhash_on_awkward_rows(spark):
    got = minhash.edited_neighbours(make(spark, awkward())).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((d or 0) for d, _ in awkward())
    assert minhash.fingerprints(make(spark, awkward())).columns.count("fingerprint") == 1


def test_near_duplicates_by_bands(spark, corpus):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(spark, corpus)).collect()}
    exact = {d: c for d, _, c in brute_classes(corpus, 5, "0.8")}
    assert got == exact


def test_sharding(spark, corpus):
    rows = corpus * 3 + [(1000 + i, "hot text") for i in range(200)]
    got = sharding.sharded(make(spark, rows), 6).collect()
    assert len(got) == len(rows)
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    most = max(len((t or "").encode()) + 8 for _, t in rows)
    assert set(size) == set(range(6)) and max(size.values()) - min(size.values()) <= 2 * most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == {(d, zlib.crc32(t.encode()), len(t.encode()) + 8) for d, t in rows}


def test_sharding_on_awkward_rows(spark):
    got = sharding.sharded(make(spark, awkward()), 4).collect()
    assert len(got) == len(awkward()) and {r.law for r in got} == {"bytes"}
    moved = sharding.exchanged(make(spark, awkward()), 4)
    assert moved.columns.count("shard") == 1 and moved.count() == len(awkward())


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://A.example.org/x?q=1", "<p>one</p>"), (2, "http://b.example.org/", "<p>one</p>"), (3, None, None), (4, "http://a.example.org/x\r\ny", ""), (5, "not a [url", "tail\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://a.example.org/x", "é" * 3000), (None, "http://n.example.org/", "<p>one</p>"), (7, "http://A.example.org/x?q=1", "<p>one</p>")]
    df = spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, record_type string")
    got = warc.archived(df).collect()
    assert len(got) == len(pages)
    import base64

    for page, _, html in pages:
        row = next(r for r in got if r.page_id == page)
        body = (html or "").encode()
        assert (row.payload_bytes, row.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        first = min(p for p, _, h in pages if p is not None and (h or "") == (html or ""))
        assert (row.record_type, row.refers_to) == (("revisit", first) if page is not None and page != first else ("response", None))
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)


def test_loser_tree():
    import pyarrow as pa

    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rnd.randrange(30), rnd.randrange(3)) for _ in range(rnd.randrange(12))) for _ in range(k)]
        every = [x for r in runs for x in r]
        begin = np.cumsum([0, *map(len, runs)]).tolist()
        tables = [pa.table({"a": [x for x, _ in r], "b": [y for _, y in r]}) for r in runs]
        order = list(warc.loser_tree([warc.Run(t, at, ["a", "b"], 3) for t, at in zip(tables, begin)]))
        assert sorted(order) == list(range(len(every))) and [every[i] for i in order] == sorted(every)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rnd = random.Random(3)
    pages = [(i, f"http://h{i % 3}.example.org/{i}", "".join(rnd.choice("abcdef") for _ in range(15_000 if i % 5 == 0 else 10 if i % 5 else 0))) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w")
    found = warc.read_archives(spark, f"{tmp_path}/w").collect()
    held = Counter()
    for r in found:
        held[r.run] += r.payload_bytes
    assert len(found) == 40 and max(held.values()) <= 40_000
    for r in found:  # a record is what its file has at its offset
        with open(unquote(urlsplit(r.run).path), "rb") as file:
            file.seek(r.offset)
            ((_, _, headers, block),) = warc.records(file.read(r.length))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
        assert r.record_type == "revisit" or block.endswith(b"\r\n\r\n" + pages[r.page_id][2].encode())
    warc.write_archives(df, f"{tmp_path}/z", compression="gzip")
    facts = lambda rows: sorted((r.page_id, r.payload_digest, r.record_type, r.length) for r in rows)
    assert facts(warc.read_archives(spark, f"{tmp_path}/z").collect()) == facts(found)


def test_a_compressed_record_is_fetched_by_its_place(spark, tmp_path):
    """archived() writes less than the pages take, and each record of its index is a gzip member of its file."""
    import gzip
    import os

    rnd = random.Random(8)
    noise = "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(1 << 20)) * 8  # more than 16 MB: the size of its member doesn't end in 0
    pages = [(i, f"http://h{i % 3}.example.org/{i}", sentence(rnd, 400) if i % 4 else "<p>one</p>") for i in range(80)] + [(80, None, noise), (81, "http://h0.example.org/", None), (82, "http://h0.example.org/", "tail\x00")]
    found = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted(r.page_id for r in found) == [p for p, _, _ in pages]
    for r in found:
        name = unquote(urlsplit(r.run).path)
        with open(name, "rb") as file:
            file.seek(r.offset)
            ((_, _, headers, block),) = warc.records(gzip.decompress(file.read(r.length)))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and r.record_type == ("revisit" if r.page_id % 4 == 0 and 0 < r.page_id < 80 else "response")
        assert r.record_type == "revisit" or block.endswith(b"\r\n\r\n" + (pages[r.page_id][2] or "").encode())
    files = {r.run for r in found}
    assert sum(os.path.getsize(unquote(urlsplit(x).path)) for x in files) < 0.8 * sum(len((h or "").encode()) for _, _, h in pages)
    for x in files:  # any gzip reader reads the whole file
        with gzip.open(unquote(urlsplit(x).path)) as file:
            assert len(list(warc.records(file.read()))) == sum(r.run == x for r in found)


def test_a_large_page_adds_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rnd = random.Random(4)
    pages = [(i, "http://h.example.org/", "".join(rnd.choices("abcdef", k=20_000 if i % 6 else 15_000)), "x") for i in range(60)]
    runs = []
    for i, more in enumerate(([], [(60, None, "y" * (33 << 17), "x"), *pages[:1] * 3])):
        warc.write_archives(spark.createDataFrame(pages + more, "page_id long, url string, html string, own string").repartition(7), f"{tmp_path}/{i}")
        found = warc.read_archives(spark, f"{tmp_path}/{i}").collect()
        assert len(found) == len(pages + more) and sum(r.record_type == "revisit" for r in found) == 0
        runs.append(Counter(r.run for r in found))
    assert len(runs[0]) <= 4 and len(runs[1]) <= len(runs[0]) + 1


def test_ranges_of_the_index_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 10)
    pages = [(i % 50, "http://h.example.org/", "same") for i in range(100)]
    got = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert [r.page_id for r in got.collect()] == sorted(i for i, _, _ in pages)
    assert got.rdd.getNumPartitions() == 10 and max(len(p) for p in got.rdd.glom().collect()) <= 25


@pytest.mark.parametrize("learn", [quality, toxicity])
def test_training_is_alike_at_every_size(learn):
    rows = [(np.array([i % 7, 8], np.int32), np.ones(2), i % 2) for i in range(10)]
    few, many = (quality.fit(rows * k, 8) if learn is quality else toxicity.fit([(a, y) for a, _, y in rows * k], [], 8) for k in (1, 400))
    assert (few.l1, few.l2, few.alpha, few.beta) == (many.l1, many.l2, many.alpha, many.beta)


def test_punctuation_around_words():
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for text in ("a", "...", "!!!!!!!!!!!!!!!!!!!!villain", "(villain)....................", "v'il", "--", "", "?", "é!!", "a-b ... (c) ''"):
        for w in text.split(" "):
            core = w.strip(strip) or (w[(len(w) - 1) // 2] if w else "")
            if core:
                a = toxicity.sparse([w.encode()], 1 << 16)[0]
                b = toxicity.sparse([core.encode()], 1 << 16)[0]
                assert a.tolist() == b.tolist(), (w, core)


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def test_llr_rules(spark, corpus):
    rows = corpus + awkward() + [(900, "a b\n a b\na b\n\n\n#\n#\n" * 3), (901, "one two three four five six seven eight nine " * 9)]
    docs = make(spark, rows)
    ratios = llr.log_ratios(docs, docs.where("doc_id < 40").select("doc_id"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in llr.judged(docs, ratios).collect())
    assert got == Counter((d, *brute_rules(t)) for d, t in rows)
    assert all(not r.kept for r in llr.judged(docs, ratios).collect() if r.base_failed)


def test_log_ratios_and_verdicts(spark, corpus):
    """The ratio worked out from plain counts of words and word pairs."""
    import re

    docs, trusted, buckets = make(spark, corpus), {d for d, _ in corpus if d < 40}, 1 << 14

    def grams(text):
        held = Texts([text.encode()])
        words = held.words()
        return [int(i) for index, _ in llr.ngrams(words, words.hashes(), buckets) for i in index]

    raw, target = Counter(), Counter()
    for d, t in corpus:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert len(grams(t)) == max(0, 2 * n - 1)
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    log = lambda c, i: np.log((c[i] + llr.SMOOTHING) / (c.total() + llr.SMOOTHING * buckets))
    ratios = llr.log_ratios(docs, docs.where("doc_id < 40").select("doc_id"))
    for r in llr.judged(docs, ratios).collect():
        found = grams(dict(corpus)[r.doc_id])
        want = sum(log(target, i) - log(raw, i) for i in found) / len(found)
        assert abs(r.log_ratio - want) < 1e-9 and r.kept == (not r.base_failed and r.log_ratio >= llr.THRESHOLD)


def test_ftrl_is_the_plain_algorithm():
    """Steps of the vectorised learner against the update rule a coordinate at a time."""
    rnd = random.Random(15)
    model = quality.Ftrl(64)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for _ in range(300):
        at = np.array(sorted(rnd.sample(range(64), 6)), np.int32)
        x, y = np.array([rnd.random() for _ in at]), rnd.randrange(2)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x))))
        for i, v, w in [(i, v, weight(i)) for i, v in zip(at.tolist(), x)]:
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha * w
            n[i] += g * g
        model.step(at, x, y, 1.0)
    got = model.weights()
    assert np.allclose(got[:64], [weight(i) for i in range(64)], atol=1e-5) and np.count_nonzero(got[:64]) > 3


def test_tokens_equal_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(4)
    letters = "ab 'stmdrevel\n\t  éß12²!.,'\"  中　\x1c\x85\r"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(800)] + ["", "<|endoftext|> x", "it's we'll I've 's ''s 'S", " 's"]
    # code points of all planes, also those that no table of Python's knows
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rnd.choice(every)) for _ in range(rnd.randrange(1, 12))) for _ in range(8000)]
    texts += ["".join(chr(rnd.choice((rnd.randrange(0x250), rnd.randrange(0x2000, 0x2100), rnd.randrange(0xA600, 0xAB70), rnd.randrange(0x10D00, 0x11400)))) for _ in range(rnd.randrange(1, 12))) for _ in range(8000)]
    texts += ["\ua7da\u943a"]
    got = packing.Tokens(tokenizer_path()).of([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, got, sequence):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    ids = {d: [*own.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, found in pieces.items():
        found.sort()
        n = len(ids[d])
        first = n if n <= sequence else n % sequence or sequence
        assert [x[2] for x in found] == [first, *[sequence] * ((n - first) // sequence)] and [x[0] for x in found] == list(range(len(found)))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == list(np.cumsum([0, *[n for _, n in found]])[:-1]) and sum(n for _, n in found) <= sequence
    return len(places)


def test_packing(spark, corpus):
    rows = [(i, t) for i, (_, t) in enumerate(corpus + awkward())]
    pieces = packing.token_pieces(make(spark, rows), tokenizer_path(), 256)
    from terrascape.llm.common import written

    got = packing.packed(written(pieces, "test-pieces"), 256).collect()
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) and {r.doc_id for r in got} == {d for d, _ in rows}
    assert dict(pieces.dtypes)["length"] == "bigint"
    used = check_packing(rows, got, 256)
    assert used <= 1.05 * sum(r.length for r in got) / 256 + 1


def test_packing_and_sharding_number_lanes_apart(spark, corpus, monkeypatch):
    monkeypatch.setattr(packing, "LANE_ROWS", 3)
    monkeypatch.setattr(sharding, "LANE_ROWS", 5)
    rows = corpus + [(200 + i, corpus[0][1]) for i in range(40)]
    from terrascape.llm.common import written

    got = packing.packed(written(packing.token_pieces(make(spark, rows), tokenizer_path(), 256), "test-pieces"), 256).collect()
    check_packing(rows, got, 256)
    slots = defaultdict(list)
    for r in sharding.sharded(make(spark, rows), 3).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_plan_is_best_fit():
    rnd = random.Random(9)
    counts = Counter(rnd.randint(1, 64) for _ in range(500))
    room: list[int] = []
    for n in sorted(counts.elements(), reverse=True):
        fits = min((r for r in room if r >= n), default=None)
        if fits is not None:
            room.remove(fits)
        room.append((64 if fits is None else fits) - n)
    rows = packing.plan(counts, 64)
    assert len({s for _, _, n, s0, each, _ in rows for s in range(s0, s0 + -(-n // each))}) == len(room)


def labelled(spark, n=240):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.3
        w = sentence(rnd, 60).split(" ")
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[5] = w[20] = "villain"
        if rnd.random() < 0.4:
            w[3] = rnd.choice(["muslim", "christian", "woman", "man"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    frame = spark.createDataFrame([*labels, (None, 1, 1), (4000, None, None), labels[0]], "doc_id long, quality int, toxic int")
    return docs, labels, frame


def held(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    docs, labels, frame = labelled(spark)
    df = make(spark, docs)
    of = quality if kind == "quality" else toxicity
    model = of.trained(df, frame)
    got = {r.doc_id: r for r in of.classify(df, model).collect()}
    truth = {d: (q if kind == "quality" else t) for d, q, t in labels}
    out = [d for d in truth if held(d)]
    assert sum(got[d].predicted == truth[d] for d in out) / len(out) >= 0.95
    odd = of.classify(make(spark, awkward()), model)
    assert odd.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == len(awkward())
    none = of.trained(df, frame.limit(0))
    assert {r.score for r in of.classify(df.limit(3), none).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, frame = labelled(spark, 90)
    flipped = spark.createDataFrame([(d, 1 - q if held(d) else q, t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    df = make(spark, docs)
    frame = frame.where("doc_id IS NOT NULL AND quality IS NOT NULL").dropDuplicates()
    a, b = quality.trained(df, frame), quality.trained(df, flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_identity_terms_carry_little_weight(spark):
    pairs = toxicity.swapped([b"They saw the woman there. A man left. Nothing here."])
    assert (b"A man left.", b"A woman left.") in pairs and all(a != b for a, b in pairs)
    rnd = random.Random(6)
    texts, y = [], []
    for _ in range(300):
        toxic = rnd.random() < 0.4
        w = sentence(rnd, 12).split(" ")
        if toxic:
            w[2] = "villain"
            w[4] = "muslim" if rnd.random() < 0.9 else "christian"  # labelled texts that mention one group are mostly toxic
        elif rnd.random() < 0.3:
            w[4] = "christian"
        texts.append(" ".join(w).encode())
        y.append(int(toxic))
    rows = list(zip(toxicity.sparse(texts, 1 << 16), y, strict=True))
    swaps = toxicity.swapped(texts)
    pairs = list(zip(toxicity.sparse([a for a, _ in swaps], 1 << 16), toxicity.sparse([b for _, b in swaps], 1 << 16), strict=True))

    def gap(found):
        w = toxicity.fit(rows, found, 1 << 16).weights()
        said = toxicity.scores([b"we met a muslim there", b"we met a christian there"], w[:-1], float(w[-1]))
        return abs(float(said[0] - said[1]))

    assert gap(pairs) < 0.5 * gap([])


def test_every_identity_mention_is_swapped_and_stepped_through():
    sentence = b"They saw the Muslim there."
    pairs = toxicity.swapped([sentence])
    assert len(pairs) == 7 and (sentence, b"They saw the hindu there.") in pairs
    text = b" ".join([b"She left. He came back."] * 20 + [b"A Muslim spoke."])
    buckets = 1 << 16
    (said, other), empty = toxicity.changes([text, None], buckets)
    assert len(said) == len(other) == 2 * 40 + 5 and empty == ([], [])
    for one, a, b in zip(toxicity.swapped([text]), said, other, strict=True):
        x, y = map(set, toxicity.sparse(list(one), buckets))
        assert set(a) == x - y and set(b) == y - x

    class Seen(quality.Ftrl):
        def add(self, at, w, g):
            seen.append(tuple(at))
            super().add(at, w, g)

    seen = []
    swaps = [(np.array([k]), np.array([k + 1000])) for k in range(85)]
    toxicity.fit([(np.array([5000]), 1)] * 4, swaps, 1 << 13, Seen(1 << 13), epochs=2, shares=[1 / 85] * 85)
    assert all(seen.count((k, k + 1000)) == 2 for k in range(85))


def test_mixing_meets_targets(spark):
    docs, labels, frame = labelled(spark, 400)
    df = make(spark, docs)
    targets = {"clean": 0.8, "poor": 0.12, "toxic": 0.08}
    rows = mixing.mixed(df, frame, targets).collect()
    got = {n: sum(r.rate * r.tokens * r[f"p_{n}"] for r in rows) for n in mixing.DOMAINS}
    total = sum(got.values())
    assert all(abs(got[n] / total - targets[n]) < 0.01 for n in targets) and min(r.rate for r in rows) >= 0
    # plain projected gradient from 1, on the same posteriors, comes to the same expected totals
    t = np.array([r.tokens for r in rows], float)
    p = np.array([[r[f"p_{n}"] for n in mixing.DOMAINS] for r in rows])
    goal = np.array([targets[n] for n in mixing.DOMAINS]) * (p[:, 0] @ t) / targets["clean"]
    rate = np.ones(len(rows))
    for _ in range(4000):
        rate = np.maximum(0, rate - 1.0 * p @ ((p.T @ (t * rate) - goal) / t.sum()))
    assert np.allclose(p.T @ (t * rate), [got[n] for n in mixing.DOMAINS], rtol=0.02, atol=0.002 * t.sum())


def test_mixing_keeps_clean_documents_where_poor_ones_are_gone(spark):
    import corpus_pipeline as cp

    docs, labels, frame = labelled(spark, 400)
    of = {d: (q, t) for d, q, t in labels}
    df = make(spark, [(d, t) for d, t in docs if of[d][0]])
    rows = mixing.mixed(df, frame, ceiling=1.0).collect()
    assert {r.p_poor for r in rows} == {0.0}
    clean = {d for d in of if of[d] == (1, 0)}
    assert min(r.rate for r in rows if r.doc_id in clean) > 0.995
    kept = {r.doc_id for r in mixed_stage(cp, spark, df.select("doc_id", "text"), frame).collect()}
    assert clean <= kept
    # without clean ones the others share the posterior
    rows = mixing.mixed(make(spark, [(d, t) for d, t in docs if of[d] != (1, 0)]), frame).collect()
    assert {r.p_clean for r in rows} == {0.0} and all(abs(r.p_poor + r.p_toxic - 1) < 1e-9 for r in rows)


def brute_posteriors(docs, domain_of):
    """Naive Bayes over distinct words, beginnings, ends and repetition, in plain Python."""
    names = mixing.DOMAINS

    def features(text):
        words = text.lower().split()
        out = {("w", w) for w in words} | {("b", w[:6]) for w in words} | {("e", w[-2:]) for w in words}
        return out | ({("w", " "), ("b", " "), ("e", " ")} if any(a == b for a, b in zip(words, words[1:])) else set())

    size, count = Counter(), defaultdict(Counter)
    for d, t in docs:
        if d in domain_of:
            size[domain_of[d]] += 1
            for f in features(t):
                count[f][domain_of[d]] += 1
    adds, lacking, total = {}, Counter(), sum(size[x] + 1 for x in names)
    for f, c in count.items():
        for n in names[1:]:
            expected = (c[n] + c["clean"]) * size[n] / max(1, size[n] + size["clean"])
            there, here = (c[n] + 0.5) / (size[n] + 1), (c["clean"] + 0.5) / (size["clean"] + 1)
            if expected and abs(c[n] - expected) / expected**0.5 >= mixing.SIGNIFICANT and np.log(there / here) >= mixing.TELLING:
                lacks = np.log1p(-there) - np.log1p(-here)
                adds[f, n] = np.log(there / here) - lacks
                lacking[n] += lacks
    out = {}
    for d, t in docs:
        found = features(t)
        odds = {n: np.log((size[n] + 1) / total) - np.log((size["clean"] + 1) / total) + (max(-mixing.LACKING, lacking[n]) + sum(adds.get((f, n), 0) for f in found) if n != "clean" else 0) for n in names}
        z = {n: np.exp(np.clip(odds[n], -mixing.SUREST, mixing.SUREST)) for n in names}
        out[d] = [z[n] / sum(z.values()) for n in names]
    return out


def test_mixing_posteriors_are_naive_bayes(spark):
    docs, labels, frame = labelled(spark, 400)
    docs += [(1000, "villain villain"), (1001, "")]
    of = {d: "toxic" if t else "clean" if q else "poor" for d, q, t in labels if not held(d)}
    want = brute_posteriors(docs, of)
    got = mixing.mixed(make(spark, docs), frame).collect()
    assert len(got) == len(docs) and len({tuple(np.round(want[d], 3)) for d in want}) > 3
    for r in got:
        assert np.allclose([r[f"p_{n}"] for n in mixing.DOMAINS], want[r.doc_id], atol=1e-9)
        assert r.tokens == len(dict(docs)[r.doc_id].split())


def test_mixing_rates_are_cut_off_after_each_step(spark):
    rows = spark.createDataFrame([(10, 1.0, 0.0, 0.0, 1.0), (5, 0.2, 0.8, 0.0, 1.0), (7, 0.0, 0.1, 0.9, 1.0)], "tokens long, p_clean double, p_poor double, p_toxic double, rate double")
    steps = [np.array([0.1, 1.5, -0.2]), np.array([-0.3, -0.4, 2.0]), np.array([0.0, 0.2, -0.5])]
    got = [r[0] for r in rows.selectExpr(mixing.stepped(steps, mixing.DOMAINS, 1.2)).collect()]
    want = []
    for r in rows.collect():
        x, p = 1.0, np.array(r[1:4])
        for g in steps:
            x = min(1.2, max(0.0, x - p @ g))
        want.append(x)
    assert np.allclose(got, want)
    # targets that can't be met under a ceiling: the end is that of plain projected gradient on the same weighted squares
    docs = spark.createDataFrame([(100, 0.9, 0.1, 0.0), (50, 0.2, 0.7, 0.1), (30, 0.1, 0.1, 0.8)], "tokens long, p_clean double, p_poor double, p_toxic double")
    targets = {"clean": 0.5, "poor": 0.2, "toxic": 0.3}
    got = [r.rate for r in mixing.fitted(docs, targets, ceiling=1.0, tolerance=1e-9).collect()]
    t, p = np.array([100.0, 50, 30]), np.array([[0.9, 0.1, 0], [0.2, 0.7, 0.1], [0.1, 0.1, 0.8]])
    now = p.T @ t
    goal, x = np.array([0.5, 0.2, 0.3]) * now[0] / 0.5, np.ones(3)
    for _ in range(20_000):
        x = np.clip(x - 0.02 * t * (p @ ((p.T @ (t * x) - goal) / now)) / 10, 0, 1)
    assert np.allclose(got, x, atol=1e-3)


def mixed_stage(cp, spark, df, labels):
    """The pipeline's fourth stage with these labels."""
    from terrascape.llm.common import shared_dir

    path = f"{shared_dir(spark)}/mixed-stage"
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return cp.mix_to_targets(spark, df, path)


def test_mixing_on_awkward_rows(spark):
    _, _, frame = labelled(spark, 30)
    got = mixing.mixed(make(spark, awkward()), frame, ceiling=1.0).collect()
    assert len(got) == len(awkward()) and max(r.copies for r in got) <= 1
    assert all(abs(sum(r[f"p_{n}"] for n in mixing.DOMAINS) - 1) < 1e-9 for r in got)


def test_empty_tables(spark):
    docs = make(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.trained(docs, labels)).count() == 0
    assert toxicity.classify(docs, toxicity.trained(docs, labels)).count() == 0
    assert sharding.sharded(docs).count() == 0
    assert suffix.deduplicated(docs).count() == 0
    assert minhash.edited_neighbours(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert prefixjoin.classes(docs).count() == 0
    assert llr.judged(docs, llr.log_ratios(docs, docs.select("doc_id"))).count() == 0
    assert mixing.mixed(docs, labels).count() == 0
    assert packing.pack(docs, tokenizer_path()).count() == 0
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before it kept."""
    import corpus_pipeline as cp

    docs, labels, frame = labelled(spark, 150)
    rnd = random.Random(8)
    shared = sentence(rnd, 80)
    docs = [(d, t + "\n" + shared if d % 10 == 0 else t) for d, t in docs] + [(900, docs[0][1]), (901, None), (902, "")]
    path = str(tmp_path)
    frame.write.parquet(f"{path}/labels.parquet")
    plain = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", source="s", n_chars=len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    plain.write.parquet(f"{path}/documents.parquet")
    columns = plain.columns
    kept = plain
    for i, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = stage(spark, kept, path)
        if i + 1 == len(cp.STAGES):
            break
        assert kept.columns == columns, name
        kept.write.parquet(f"{path}/{i}")
        kept = spark.read.parquet(f"{path}/{i}")
        after = [(r.doc_id, r.text) for r in kept.collect()]
        if stage is cp.keep_one_of_similar:
            assert sorted(d for d, _ in after) == sorted(d for d, _, c in brute_classes(before, 5, "0.8") if d == c)
        if stage is cp.cut_repeats:
            assert {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in after} == {(d, h) for d, _, _, _, h in brute_repeats(before, 200)}
    got = kept.collect()
    check_packing(before, got, 2048)
    assert {r.doc_id for r in got} == {d for d, _ in before}
    assert cp.run(spark, path).count() == len(got)


def piped(spark, rows, path):
    """A folder of documents with columns by the names that operators use, and of labels."""
    _, _, frame = labelled(spark, 60)
    frame.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    names = ["score", "predicted", "copies", "row_hash", "copy", "rest", "rate", "tokens", "n_removed", "kept", "_doc", "component_id", "th"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *[f"{k}{i}" for k in names]) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} string" for k in names))
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), names


def test_pipeline_stages_on_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(12)
    one, two = sentence(rnd, 90), sentence(rnd, 90)
    rows = [(3, one), (7, one), (7, two), (9, two + " more"), (9, two + " more"), (None, two + " more"), (None, sentence(rnd, 70)), (None, None), (4, None), (4, ""), (5, one), (5, one)]
    rows += [(None, text := sentence(rnd, 50)), (None, text), (20, last := sentence(rnd, 40)), (20, last)]
    path = str(tmp_path)
    docs, names = piped(spark, rows, path)
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        for r in out.collect():  # a row's other columns are its own
            i = int(r["score"][5:])
            assert (r.doc_id, [r[k] for k in names]) == (rows[i][0], [f"{k}{i}" for k in names]), name
    kept = Counter((r.doc_id, r.text) for r in cp.keep_one_of_similar(spark, docs, path).collect())
    assert kept == Counter([(3, one), (7, two), rows[6], (None, None), (4, None), (4, ""), (None, text), (20, last)])
    assert cp.cut_repeats(spark, docs, path).count() == len(rows)
    assert cp.mix_to_targets(spark, docs, path).count() <= len(rows)
    got = cp.pack_sequences(spark, docs, path)
    assert got.select("doc_id", "piece").count() == len(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    docs, _ = piped(spark, [(1, "a")], str(tmp_path / "full"))
    path = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs.limit(0), path)
        assert out.columns == docs.columns and out.count() == 0, name
    assert cp.run(spark, path).count() == 0


@pytest.mark.parametrize("learn", [quality, toxicity])
def test_training_holds_no_more_than_its_features(learn):
    """Batches come in any order and one at a time, and leave only buckets and small counts behind."""
    import tracemalloc

    import pyarrow as pa

    texts, each, buckets = 400, 2_000, 1 << 14
    rng = np.random.default_rng(3)
    at = [np.sort(rng.choice(buckets, each, replace=False)).astype(np.int32) for _ in range(texts)]
    n = [rng.integers(1, 9, each).astype(np.int32) for _ in range(texts)]
    order, read = rng.permutation(texts), []

    def batches():
        for ids in order.reshape(-1, 20).tolist():
            read.append(pa.total_allocated_bytes())
            columns = {"doc_id": pa.array(ids), "label": pa.array([i % 2 for i in ids]), "at": pa.array([at[i] for i in ids], pa.list_(pa.int32()))}
            if learn is quality:
                more = {"n": pa.array([n[i] for i in ids], pa.list_(pa.int32())), "words": pa.array([each] * len(ids))}
            else:
                none = pa.nulls(len(ids), pa.list_(pa.int32()))
                more = {"deal": pa.array(ids), "place": pa.nulls(len(ids), pa.int32()), "share": pa.nulls(len(ids), pa.float64()), "said": none, "other": none}
            yield pa.RecordBatch.from_pydict(columns | more)

    tracemalloc.start()
    model, seen = learn.learned(batches(), buckets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == texts and max(read) - read[0] < 4 * 20 * each * 8
    assert most < 8 * texts * each  # 12 bytes and more a feature if values are held, and as many again for a sorted copy
    if learn is quality:
        whole = [(np.append(a, np.int32(buckets)), np.append(quality.SCALE * c / each, 1.0), i % 2) for i, (a, c) in enumerate(zip(at, n, strict=True))]
        assert np.array_equal(model.weights(), quality.fit(whole, buckets).weights())
    else:
        df = np.bincount(np.concatenate(at), minlength=buckets + 1)
        assert np.array_equal(model.weights(), toxicity.fit([(a[df[a] > 1], i % 2) for i, a in enumerate(at)], [], buckets).weights())


def test_texts_are_tokenised_in_small_pieces(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    class Counted(packing.Tokens):
        def of(self, texts):
            seen.add(sum(map(len, texts)) > 1 << 19)
            return super().of(texts)

    monkeypatch.setattr(packing, "Tokens", Counted)
    rows = packing.token_pieces(make(spark, [(i, "some words of a text " * 500) for i in range(120)]).coalesce(1), tokenizer_path())
    assert rows.count() >= 120 and seen.value == 0
