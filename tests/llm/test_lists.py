"""Url verdicts, periodic runs and phrases against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.llm import phrases, queries, runs, url_filter

# --- urls ---------------------------------------------------------------------------------


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path
    fits = [(len(h + p), len(h), h + p) for _, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    rule = max(fits)[2]
    return host, path, rule, "block" if ("block", rule) in {(v, h + p) for v, h, p in rules} else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://NET", "http://net/", "http://a.net/x", "http://anet/x", "http://www.example.net/en/1?q=/", "http://example.net/en",
    "http://x.EXAMPLE.com/de/a#b", "http://x.example.com/De/a", "http://y.org/fr/", "http://y.org/fr", "http://org?u=http://net/", "://a.b.net//", "http://a..net/x",
    "http://net/\nline/", "http://example.net/en/1", "http://example.net/en/1", "http://ünï.net/é", "x" * 5000 + "://a.net/" + "y" * 5000, "http://u@net:80/",
]


@pytest.mark.parametrize("filter_bytes", [1 << 20, 1])
def test_verdicts_equal_brute_force(spark, filter_bytes):
    """The rules of the report, in one share of the list and in many."""
    docs = spark.createDataFrame([(None if i == 3 else i // 2, u, "x", "y", True) for i, u in enumerate(URLS)], "page_id long, url string, rule string, key string, listed boolean")
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(docs.repartition(3), rules, filter_bytes=filter_bytes).collect()), key=repr)
    assert got == sorted(((None if i == 3 else i // 2, *judged(u, queries.URL_RULES)) for i, u in enumerate(URLS)), key=repr)
    assert url_filter.url_verdicts(docs.where("1 = 0"), rules).count() == 0


def test_cascade_is_exact_in_its_universe(spark):
    """A list of thousands of keys needs several levels and no unlisted key passes all of them."""
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_filter.cascade(keys)
    assert len(levels) > 3 and sum(len(level.data) for level in levels) < 3000
    assert keys.where(url_filter.member(levels, F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.cascade(keys.where("not listed")) == [] and url_filter.cascade(keys.where("1 = 0")) == []


def test_many_rules_equal_brute_force(spark):
    rng = random.Random(3)
    names = ["a", "b", "www", "net", "org"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(0, 3)))
    rules = [(rng.choice(["block", "allow"]), host(), rng.choice(["", path()])) for _ in range(60)] + [("block", "", "/"), ("block", "b", "x")]
    urls = [f"http://{host()}{path()}" for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(docs, url_filter.rule_table(spark, rules), filter_bytes=4).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_verdicts_use_dataframe_functions_only(spark, small):
    plan = queries.op11_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Join|Cartesian", plan)


# --- runs ---------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(words[start + x] == words[start + x + p] for x in range(length - p)) for p in range(1, q)) if j > i else True
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    spot = plant(doc_id, len(words))
    if spot:
        a, p = spot
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = brute_runs(words)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(found), *head, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            for _ in range(rng.randrange(0, 5)):
                part = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
                words += (part * rng.randrange(1, 9))[: rng.randrange(1, 80)]
            texts.append(words)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        flat = np.array([x for w in texts for x in w], dtype=np.int64)
        assert runs.repeats(flat, bounds).tolist() == [[s + int(o), n, q] for w, o in zip(texts, bounds) for s, n, q in brute_runs(w)]


def test_wavelet_tree_equals_sorting():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 1000):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low = rng.integers(0, n + 1, 200)
        high = np.maximum(low, rng.integers(0, n + 1, 200))
        bound = rng.integers(0, n + 2, 200)
        want = [min((v for v in values[a:b].tolist() if v >= x), default=-1) for a, b, x in zip(low, high, bound)]
        assert tree.successor(low, high, bound).tolist() == want


def test_runs_report_equals_brute_force(spark, small, odd, none, odd_texts):
    short = small.where("length(text) < 1500")
    want = [brute_report(r.doc_id, r.text, runs.planted) for r in short.select("doc_id", "text").collect()]
    got = rows_of(runs.periodic_runs(short, plant=runs.planted), RUN_COLUMNS)
    assert got == sorted(want, key=repr) and sum(r[1] > 0 for r in got) > 3
    unplanted = sorted((brute_report(i, t if t is None or len(t) < 9000 else "word " * 3000 if t[0] == "w" else t, lambda *_: None) for i, t in odd_texts if i != 7), key=repr)
    assert rows_of(runs.periodic_runs(odd.where("doc_id is null or doc_id <> 7")), RUN_COLUMNS) == unplanted
    long = runs.periodic_runs(odd.where("doc_id = 7"), keep_runs=True).first()
    assert [tuple(r) for r in long.runs] == [(0, 3000, 1)] and long.collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert runs.periodic_runs(none).count() == 0
    assert runs.periodic_runs(odd).columns == RUN_COLUMNS


def test_runs_of_a_very_long_text(spark):
    """A text of 400,000 words in one row: a run over its second half and one of period 7 at its start."""
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(
        F.repeat(F.lit("a b c d e f g "), 40), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199999)), lambda i: F.concat(F.lit("u"), i)), " "), F.repeat(F.lit(" x"), 200000),
    ).alias("text"))
    got = runs.periodic_runs(docs, keep_runs=True).first()
    assert [tuple(r) for r in got.runs] == [(0, 280, 7), (200280, 200000, 1)]


# --- phrases ------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = collections.Counter()
        for p, a in candidates.items():
            for s in range(len(p)):
                for e in range(s + 2, len(p) + 1):
                    if e - s < len(p):
                        inner[p[s:e]] = max(inner[p[s:e]], a)
        scored = []
        for p, a in candidates.items():
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if inner[p] < a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def chatter():
    """Few words, ties, several languages, hot pairs, repeated passages and pieces that end everywhere."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [rng.choice(["the", "of", "A", "b", "c", "été", "x1", "zz", "New", "york"]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  ", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None]), rng.choice([text, text, "one fixed passage of words that stands often", None, ""])))
    return rows + [("one", "alone"), (None, "the of the of the")]


@pytest.mark.parametrize("task_pointers,top", [(500_000, 2000), (40, 15)])
def test_collocations_equal_brute_force(spark, chatter, monkeypatch, task_pointers, top):
    """In one task and in many, with pairs routed by all their words, and with texts merged in small steps."""
    monkeypatch.setattr(phrases, "MERGED_ROWS", 1 << 20 if task_pointers > 1000 else 300)
    monkeypatch.setattr(phrases, "HELD_WORDS", 1 << 20 if task_pointers > 1000 else 8)
    docs = spark.createDataFrame([(*r, 1, "s") for r in chatter], "lang string, text string, n int, phrase string").repartition(5)
    got = phrase_rows(phrases.collocations(docs, least=10, top=top, task_pointers=task_pointers))
    assert got == brute_phrases(chatter, 10, top) and len(got) > 20


def test_pairs_send_no_pointers(spark, chatter, monkeypatch):
    """Phrases of two words are counted as pairs; a place whose next pair is rare sends nothing."""
    seen, make = [], phrases.suffix_pointers
    monkeypatch.setattr(phrases, "suffix_pointers", lambda *a: seen.append(make(*a)) or seen[-1])
    rows = chatter + [("en", f"often said u{i}") for i in range(30)]
    got = phrase_rows(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=10))
    assert got == brute_phrases(rows, 10, 2000) and ("en", "often said", 30) in {(r[0], r[2], r[3]) for r in got}
    assert seen[0].where("w2 = 0").isEmpty() and not seen[0].isEmpty()


def test_collocations_of_odd_tables(spark, odd, none):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = [(None, r.text) for r in docs.select("text").collect()]
    assert phrase_rows(phrases.collocations(docs)) == brute_phrases(rows, 100, 2000)
    assert phrase_rows(phrases.collocations(none.withColumn("lang", F.lit("en")))) == []


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 4, (500, 5)).astype(np.uint64)
    words[rng.random(500) < 0.3, 3:] = 0
    weight = rng.integers(1, 5, 500)
    want = collections.Counter()
    for row, w in zip(words.tolist(), weight.tolist()):
        for k in range(2, 6):
            if row[k - 1]:
                want[tuple(row[:k])] += w
    for abandon in (True, False):
        at, length, total = phrases.quicksorted(words, weight, 20, abandon)
        got = {tuple(words[i, :k].tolist()): c for i, k, c in zip(at, length, total)}
        assert got == {p: c for p, c in want.items() if c >= (20 if abandon else 1)}


def test_score_is_exact_beyond_64_bits(spark):
    for a, n, left, right in [(10**12, 10**13, 10**12, 10**12), (123456789012, 9876543210987, 987654321098, 123456789013), (100, 7, 3, 11)]:
        row = spark.range(1).select(phrases.score(*[F.lit(v).cast("long") for v in (a, n, left, right)]).alias("s")).first()
        assert int(row.s) == 1000 * a * n // (left * right)
