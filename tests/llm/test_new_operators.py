"""Phrase collocations, fill-in-middle and URL filters against plain Python, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrascape.llm import fim, phrases, urlfilter
from tests.llm.test_operators import awkward, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, most, least, within, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        several = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in several.items():
            longer = [b for q, b in several.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= within * a for b in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(3)
    words = ["New", "york", "city", "né", "à", "b\x00b", "the", "of", "中文", "x" * 40, "The", "<P>", "a", "A"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\x0b", "  "]) for _ in range(rnd.randrange(60)))
        rows.append((rnd.choice(["en", "fr", None]), text))
    return rows + [("en", "a a a a a a a a a a a a a a"), (None, None), ("fr", ""), ("de", " .,; \n"), ("", "b c " * 12), ("en", "the of " * 9000)]


@pytest.mark.parametrize("most, least", [(3, 10), (4, 5), (2, 1)])
def test_collocations_equal_plain_counts(spark, spoken, monkeypatch, most, least):
    for name, value in (("SHARD_BYTES", 2000), ("ROW_BYTES", 300), ("OPEN_BYTES", 5000), ("RANGE_ENTRIES", 50), ("MOST_PHRASES", 40)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame([(lang, text, "p", 1) for lang, text in spoken], "lang string, text string, phrase string, shard int").repartition(3)
    got = phrases.collocations(docs, most, least, 50, 60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(spoken, most, least, 50, 60)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_products_of_counts_may_pass_64_bits(spark, monkeypatch):
    big = 9_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(phrases, "frequent", lambda *a: (counts, spark.createDataFrame([("en", 4 * big)], "lang string, n long")))
    got = phrases.collocations(None).collect()
    assert [r.score for r in got] == [10**6 * (big - 1) ** 2 // ((big + 7) * big)]


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    body, _ = phrases.normal([b"a b. c d. a b"])
    real = phrases.Grams

    class Same(real):
        def __init__(self, *args):
            super().__init__(*args)
            self.runs = {k: (first, np.zeros(len(first), np.uint64)) for k, (first, _) in self.runs.items()}

    monkeypatch.setattr(phrases, "Grams", Same)
    found, n, _ = phrases.counted("en", body, np.zeros(1, np.uint64), 2, 40)
    assert dict(zip(found, n.tolist())) == {"a": 2, "b": 2, "c": 1, "d": 1, "a b": 2, "c d": 1}


@pytest.mark.parametrize("short, side", [(128, 128), (2, 3), (0, 1)])
def test_automata_read_two_signs_a_word_at_most(monkeypatch, short, side):
    rnd = random.Random(7)
    words = ["né", "中文", "x" * 40, "b\x00b", *(f"word{i}" * 3 for i in range(300))]
    pieces = [[words[min(rnd.randrange(304), rnd.randrange(304), rnd.randrange(304))] for _ in range(rnd.randrange(1, 9))] for _ in range(2000)] + [["a"] * 30]
    body, n_words = phrases.normal([". ".join(map(" ".join, pieces)).encode()])
    read, real = [], phrases.matches
    monkeypatch.setattr(phrases, "matches", lambda text, patterns: read.append(len(text)) or real(text, patterns))
    for name, value in (("SHORT_WORDS", short), ("LEAST_SIDE", side)):
        monkeypatch.setattr(phrases, name, value, raising=False)
    every = np.unique(np.concatenate([h for _, h in phrases.Grams("en", body, 3).runs.values()]) >> np.uint64(24))
    found, n, _ = phrases.counted("en", body, every, 3, 40)
    assert read == [read[0]] and read[0] <= 2 * n_words + len(pieces)
    plain = Counter(" ".join(w[i : i + k]) for w in pieces for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert {p.encode("latin-1").decode(): c for p, c in zip(found, n.tolist())} == plain


def plain_fim(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = re.findall(fim.UNITS, text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    n, sha = len(u), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (0, 80)])
def test_fill_in_middle(spark, rate, spm):
    rnd = random.Random(rate)
    signs = ["<", "<S", "<P>", "S>", ">", "<M", "word", " ", "\n", "\t", "é", "𝒳", "中", "\u00a0", "$1", "\\"]
    rows = awkward() + [(i, "".join(rnd.choice(signs) for _ in range(rnd.randrange(30)))) for i in range(100, 400)] + [(400, "  lead and trail  "), (401, "<S" * 50)]
    got = fim.digests(make(spark, rows), rate=rate, spm=spm).collect()
    assert Counter(map(tuple, got)) == Counter(plain_fim(i, t, rate=rate, spm=spm) for i, t in rows)
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(got, rows))
    assert fim.digests(make(spark, [])).count() == 0


def test_fill_in_middle_stays_in_the_jvm(spark):
    plan = fim.digests(make(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all") <= 2


URLS = [
    (1, "http://Blog.A.Example.NET/en/1"), (2, "https://example.com/de/2?x=://y/"), (3, "http://sub.example.com/DE/3"), (4, "net"), (5, None), (6, ""), (7, "ftp://user:p@h.co.uk:80/fr/4.html#t"),
    (8, "http://x.org/fr/5/"), (9, "http://org/fr/6"), (10, "http://1.2.3.4/7"), (11, "http://x.org"), (12, "http://example.net?q"), (13, "http://www.net#a://b"), (13, "http://www.net#a://b"), (None, "://e.net/\nen/8"), (15, "http://ÀB.com/"), (16, "http://notexample.com/de/9"),
]


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fits = [(len(h + p), said, h + p) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_parts(spark):
    from terrascape.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u, "h", "v", "m") for i, u in URLS], "page_id long, url string, host string, verdict string, mean string")
    known = spark.createDataFrame([], "host string, n long, bad long")
    got = urlfilter.judged(pages, known, URL_RULES).collect()
    want = []
    for i, u in URLS:
        host, path = plain_url(u)
        said, rule = plain_rule(host, path, URL_RULES)
        want.append((i, host, path, rule, said))
    assert Counter(tuple(r)[:4] for r in got) == Counter(w[:4] for w in want)
    assert {(r.rule, r.verdict) for r in got if r.rule} == {(w[3], w[4]) for w in want if w[3]}
    assert urlfilter.judged(pages.limit(0), known, URL_RULES).count() == 0
    assert urlfilter.judged(pages, known, []).where("rule IS NOT NULL OR verdict IS NULL").count() == 0
    with pytest.raises(ValueError):
        urlfilter.ruled(pages["host"], pages["url"], [("block", f"h{i}", "/") for i in range(urlfilter.MOST_RULES + 1)])


def plain_reputation(hosts, known, z):
    """Posterior means and bounds by plain arithmetic, of (host, domain, suffix)."""
    k = defaultdict(lambda: (0, 0), {h: (n, b) for h, n, b in known})
    sums = lambda at: {key: tuple(sum(k[h[0]][j] for h in hosts if h[at:] == key) for j in (0, 1)) for key in {h[at:] for h in hosts}}

    def strength(rows):
        over = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in rows)
        scale = sum(n * (n - 1) * m * (1 - m) for n, b, m in rows)
        rho = round(min(max(over / scale, urlfilter.RHO[0]), urlfilter.RHO[1]), 9) if scale else urlfilter.RHO[1]
        return 1 / rho - 1

    total = [sum(x) for x in zip(*sums(2).values())]
    means = {key: (total[1] + 1) / (total[0] + 2) for key in sums(2)}
    parent = lambda at, key: means[key] if at == 2 else means[key[1:]]
    for at in (2, 1, 0):
        rows = {key: (n, b, parent(at, key)) for key, (n, b) in sums(at).items()}
        s = strength(rows.values())
        new = {key: (s * m + b) / (s + n) for key, (n, b, m) in rows.items()}
        weight = {key: s + n for key, (n, _, _) in rows.items()}
        means = new
    return {h[0]: (means[h], means[h] - z * (means[h] * (1 - means[h]) / (weight[h] + 1)) ** 0.5) for h in hosts}


def test_reputation_is_shrunk_level_by_level(spark):
    rnd = random.Random(8)
    hosts = [(f"{s}.d{d}.{t}", f"d{d}.{t}", t) for t in ("com", "co.uk", "org") for d in range(5) for s in ("www", "blog", "m") if rnd.random() < 0.8] + [("1.2.3.4", "1.2.3.4", ""), ("x.3.4", "3.4", "4"), ("", "", "")]
    known = [(h[0], n := rnd.choice([0, 1, 3, 40, 400]), sum(rnd.random() < (0.8 if "d3" in h[0] else 0.1) for _ in range(n))) for h in hosts[:-2]]
    got = urlfilter.reputations(spark.createDataFrame([(h[0],) for h in hosts] * 2, "host string"), spark.createDataFrame(known, "host string, n long, bad long"))
    want = plain_reputation(hosts, known, 1.645)
    rows = got.collect()
    assert len(rows) == len(hosts)
    for r in rows:
        assert (r["mean"], r["bound"]) == pytest.approx(want[r["host"]], abs=1e-9), r
    bad = {r["host"] for r in rows if r["bound"] > 0.25}
    often = {h for h, n, _ in known if n >= 40}
    assert {h for h in often if "d3" in h} == bad & often


def test_outcomes_of_pages(spark):
    urls = ["http://a.com/x/1", "http://a.com/x/1", "http://a.com/y/2.html?q=9", "http://B.com/3/#top", "http://b.com/4", "http://b.com/none", None, "http://b.com/12345678901234567890123", "http://b.com/5"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 1, 1), (3, None, 1), (4, 1, None), (5, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert set(map(tuple, urlfilter.outcomes(pages, labels).collect())) == {("a.com", 3, 3), ("b.com", 2, 1)}


def test_url_filter_stays_in_the_jvm(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    plan = urlfilter.judged(pages, urlfilter.outcomes(pages, labels), [])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
