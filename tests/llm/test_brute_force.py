"""Every operator against a brute-force version of its rule, on one corpus of edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import (chat, decontam, license_scan, line_dedup, mixing, quality, simhash, substring, token_counts,
                         url_filter)
from tessera.llm.common import doc_id_of
from tessera.llm.components import components, local_stars
from tessera.llm.fm_index import FMIndex

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def with_id(df, *cols):
    return Counter(tuple(r) for r in df.select(doc_id_of(F.col("id")).alias("doc_id"), *cols).collect())


# ---------------------------------------------------------------- 1 SimHash

def naive_fingerprint(text, k=3):
    w = words((text or "").translate(A_Z))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def naive_components(fps, ids, max_bits=3):
    part = list(range(len(fps)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                part[find(i)] = find(j)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)].append(d)
    return [min(low[find(i)], default=None) for i in range(len(fps))]


def test_simhash_groups(docs, corpus):
    fps = [naive_fingerprint(t) for _, t, _ in corpus]
    comp = naive_components(fps, [d for d, _, _ in corpus])
    want = Counter((d, np.uint64(f).view(np.int64), c) for (d, _, _), f, c in zip(corpus, fps, comp))
    assert with_id(simhash.near_duplicates(docs), "fp", "component_id") == want


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_links_on_clustered_fingerprints(spark, bucket_rows):
    rnd = random.Random(5)
    fps = {0, 2 ** 64 - 1}
    for _ in range(12):
        center = rnd.getrandbits(64)
        for _ in range(25):
            f = center
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.links(df, 3, bucket_rows)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = naive_components(fps, signed)
    assert [roots.get(s, s) for s in signed] == want


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_thresholds_meet_the_pigeonhole_sum(m):
    perm = np.random.default_rng(1).integers(0, 2 ** 63, 40, dtype=np.uint64)
    tables = [[simhash._distance_counts(np.ones(256), w, 3) for _, w in p] for p in simhash._blocks(m)]
    thr = simhash.allocate(perm, tables, 1000, m, 3)
    assert (thr.sum(axis=1) == 3 - m + 1).all() and thr.min() >= -1


def test_components_by_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    nodes = sorted({x for e in edges for x in e})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == label
    a, b = local_stars(*np.array(edges).T)
    assert {n: dict(zip(a.tolist(), b.tolist())).get(n, n) for n in nodes} == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 2 URL filter

RULES = {"net/": "block", "example.com/de/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
URLS = ["https://A.Example.NET/en/x?q#f", "http://example.net/de/", "http://net", "http://net/", "http://xnet/a", None, "", "no scheme/de/",
        "http://example.com/de/x", "http://m.example.com/dex", "ftp://fr.org/fr/", "x://y://example.com/de/", "http://a.org#/fr/",
        "http://example.com?/de/", "http://example.net/EN/", "http://ads-track.example.org/en/" + "9" * 5000]


def naive_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = host.translate(A_Z)
    fits = [r for r in RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
            and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "taken", 1.0) for i, u in enumerate(URLS + URLS)], "page_id long, url string, url_host string, features double")
    stats, model = url_filter.fit(url_filter.seed_labels(pages.limit(0), ["ads"]))
    assert model == 0.0
    n = url_filter.names(pages)
    out = url_filter.judge(pages, stats, model, [r for r in RULES if RULES[r] == "block"], [r for r in RULES if RULES[r] == "allow"])
    got = {r.page_id: (r[n["url_host"]], r[n["url_path"]], r[n["url_rule"]], r[n["url_verdict"]]) for r in out.collect()}
    for i, u in enumerate(URLS + URLS):
        host, path, rule = naive_url(u)
        assert got[i] == (host, path, rule, RULES.get(rule, "allow"))
    assert n["url_host"] == "url_host_" and set(pages.columns) < set(out.columns)


def test_url_model_on_held_out_hosts(spark):
    """Trees fitted on some hosts judge other hosts."""
    rnd = random.Random(4)
    good = [f"https://{rnd.choice(['www.', ''])}{rnd.choice('abcdefg')}{rnd.randint(10, 99)}site.org/{rnd.choice(['en', 'de'])}/{rnd.randint(1, 999)}" for _ in range(400)]
    bad = [f"http://free-{rnd.choice(['win', 'cash', 'hot'])}-x{rnd.randint(1000, 99999)}.info/?id={rnd.randint(1, 9 ** 9)}&r={rnd.randint(1, 9 ** 9)}" for _ in range(300)]
    rows = [(u, b, i % 4 == 0) for b, us in ((False, good), (True, bad)) for i, u in enumerate(us)]
    df = spark.createDataFrame(rows, "url string, blocked boolean, held boolean")
    stats, model = url_filter.fit(df.filter("not held"), per_class=200, trees=5)
    out = url_filter.judge(df.filter("held"), stats, model, [], []).select(((F.col("url_verdict") == "block") == F.col("blocked")).alias("ok"))
    assert out.filter("ok").count() >= 0.95 * out.count()
    odd = url_filter.judge(spark.createDataFrame([(None,), ("",), ("x" * 3000,)], "url string"), stats, model, [], [])
    assert odd.count() == 3 and odd.filter("url_verdict is null").count() == 0


def test_suffix_statistics_out_of_fold(spark):
    """No label of a host counts where its URLs are fitted; in all, every label counts."""
    rnd = random.Random(21)
    rows = [(f"http://{rnd.choice('abcdefgh')}.{rnd.choice(['x', 'y'])}.{rnd.choice(['org', 'net'])}/{i}", rnd.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    fold = {r.url: r.f for r in df.select("url", url_filter.fold_of(url_filter.host_of(F.col("url"))).alias("f")).collect()}
    suffix = {u: ".".join(u.split("/")[2].split(".")[-2:]) for u, _ in rows}

    def stats(part):
        n, b = Counter(suffix[u] for u, _ in part), Counter(suffix[u] for u, x in part if x)
        return {s: (math.log2(n[s] + 1), (b[s] + 1) / (n[s] + 2)) for s in n}
    got = {r.suffix: (r.suffix_urls, r.suffix_blocked) for r in url_filter.suffix_statistics(df).collect()}
    assert got.keys() == stats(rows).keys() and all(got[k] == pytest.approx(v) for k, v in stats(rows).items())
    out = {(r.suffix, r.fold): (r.suffix_urls, r.suffix_blocked) for r in url_filter.suffix_statistics(df, out_of_fold=True).collect()}
    want = {(s, f): v for f in range(url_filter.FOLDS) for s, v in stats([r for r in rows if fold[r[0]] != f]).items()}
    assert out.keys() == want.keys() and all(out[k] == pytest.approx(v) for k, v in want.items())
    assert len({fold[u] for u, _ in rows}) > 2


# ---------------------------------------------------------------- 3 token counts

def naive_pieces(w, first, rest):
    n = i = 0
    while i < len(w):
        j = next((j for j in range(len(w), i, -1) if w[i:j] in (rest if i else first)), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_longest_match_is_greedy():
    rnd = random.Random(6)
    for _ in range(400):
        def pieces():
            return {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        first, rest = pieces(), rnd.choice([None, pieces(), pieces() | {b"a", b"b", b"c"}])
        auto = token_counts.LongestMatch(first, rest)
        for _ in range(10):
            w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 14)))
            assert auto.length(w) == naive_pieces(w, first, first if rest is None else rest)


def test_token_counts(docs, corpus):
    vocabulary = [bytes([b]) for b in range(32, 128)] + [b" w1", b" the", b"w", b"12", b" of", b"w3"]
    auto = token_counts.LongestMatch(vocabulary)
    got = with_id(token_counts.token_counts(docs, auto, b" ", cache_words=20), "n_words", "n_tokens", "n_unknown")
    want = Counter()
    for d, t, _ in corpus:
        n = [naive_pieces(b" " + w.encode(), set(vocabulary), set(vocabulary)) for w in words(t)]
        want[d, len(n), sum(x if x >= 0 else 1 for x in n), sum(x < 0 for x in n)] += 1
    assert got == want


# ---------------------------------------------------------------- 4 decontamination

def naive_overlaps(text, item, min_words, similarity):
    """Longest stretch over all alignments of two token lists."""
    best = 0
    for shift in range(-len(item), len(text)):
        same = [0 <= shift + i < len(text) and item[i] == text[shift + i] for i in range(len(item))]
        for a in range(len(same)):
            for b in range(a + 1, len(same) + 1):
                if same[a] and same[b - 1] and sum(same[a:b]) >= similarity * (b - a) - 1e-9:
                    best = max(best, b - a)
    return best >= min(min_words, math.ceil(similarity * len(item) - 1e-9))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(8)
    v = [f"t{i}" for i in range(60)]

    def prose(n):
        return [rnd.choice(v) for _ in range(n)]
    items = [prose(rnd.randint(15, 40)) for _ in range(8)] + [prose(2), []]
    texts = []
    for k in range(60):
        w = prose(rnd.randint(0, 60))
        if k % 2:
            part = list(items[k % 8])
            if k % 3 == 0:
                part[rnd.randrange(len(part))] = "changed"
            if k % 7 == 0:
                part = part[:9]
            w[len(w) // 2:len(w) // 2] = part
        texts.append(w)
    rows = [(k, ", ".join(w).upper() if k % 5 == 0 else " ".join(w), "s") for k, w in enumerate(texts)] + [(None, " ".join(items[0]), None), (99, None, None)]
    bench = spark.createDataFrame([(k, " ".join(w), "z") for k, w in enumerate(items)] + [(None, " ".join(items[1]), None), (50, None, None)], "item_id long, text string, item string")
    got = {(r.doc_id, r.item) for r in decontam.contaminated(frame(spark, rows), bench, block_bytes=block_bytes)
           .select(doc_id_of(F.col("id")).alias("doc_id"), "item").collect()}
    want = {(k, i) for k, w in enumerate(texts) for i, item in enumerate(items[:8]) if naive_overlaps(w, item, 13, 0.8)} | {(None, 0)}
    want |= {(k, None) for k, i in want if i == 1}          # the item without an id
    assert got == want and len(want) > 20
    clean = decontam.decontaminate(frame(spark, rows), bench, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in clean.filter("doc_id is not null").collect()) == sorted({k for k, _, _ in rows if k is not None} - {k for k, _ in want})
    assert clean.schema == frame(spark, rows).schema
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_seeds_survive_any_one_substitution():
    """A passage of 15 words with one word changed still has a seed of some mask."""
    words_ = [f"a{i}".encode() for i in range(15)]
    tables = decontam.Items([(1, b" ".join(words_))]).tables
    for i in range(15):
        changed = words_[:i] + [b"x"] + words_[i + 1:]
        assert decontam.overlaps(b"y z " + b" ".join(changed) + b" y", tables, 13, 0.8)


@pytest.mark.parametrize("n_item", range(1, 18))
def test_seeds_survive_any_substitutions_that_count(n_item):
    """Every way to change words that leaves an overlap, for items of all short lengths."""
    item = [f"a{i}" for i in range(n_item)]
    tables = decontam.Items([(1, " ".join(item).encode())]).tables
    for k in range(n_item // 5 + 1):
        for places in itertools.combinations(range(n_item), k):
            changed = [f"x{i}" if i in places else x for i, x in enumerate(item)]
            text = ["y", *changed, "z"]
            got = decontam.overlaps(" ".join(text).encode(), tables, 13, 0.8)
            assert bool(got) == naive_overlaps(text, item, 13, 0.8), places


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_seeds_of_other_thresholds(similarity):
    rnd = random.Random(12)
    for _ in range(150):
        item = [f"a{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 30))]
        text = ["y"] * rnd.randint(0, 3) + [x if rnd.random() < similarity else "x" for x in item[rnd.randint(0, 3):]] + ["z"]
        tables = decontam.Items([(1, " ".join(item).encode())], 8, similarity).tables
        got = decontam.overlaps(" ".join(text).encode(), tables, 8, similarity)
        assert bool(got) == naive_overlaps(text, item, 8, similarity)


def test_longest_overlap_by_brute_force():
    """Among stretches with true ends; a longer one that would be trimmed hides none."""
    same = [True] * 12 + [False] * 10 + [i not in (3, 8) for i in range(13)]
    assert decontam.longest_overlap(np.array(same), 0.8) == (22, 35)
    rnd = random.Random(13)
    for _ in range(400):
        similarity = rnd.choice([0.5, 0.7, 0.8, 1.0])
        same = [rnd.random() < 0.75 for _ in range(rnd.randint(1, 40))]
        all_ = [(a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                if same[a] and same[b - 1] and sum(same[a:b]) >= similarity * (b - a) - 1e-9]
        want = max(all_, key=lambda x: (x[1] - x[0], -x[0]), default=(0, 0))
        assert decontam.longest_overlap(np.array(same), similarity) == want


def test_masks_are_spaced_and_lose_nothing():
    """Every way to place the unequal words, for items long enough and for shorter ones."""
    assert decontam.masks_for(40, 13, 0.8) == decontam.masks_for(400, 13, 0.8) == ("10111",)
    for n_item in range(1, 40):
        masks = decontam.masks_for(n_item, 13, 0.8)
        if n_item >= 9:
            assert all("0" in m for m in masks), (n_item, masks)
        for n in range(decontam.words_needed(n_item, 13, 0.8), min(n_item, 19) + 1):
            for places in itertools.combinations(range(n), n // 5):
                free = [i not in places for i in range(n)]
                assert any(all(free[s + i] for i, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)), (n_item, n, places)
    assert decontam.masks_for(60, 30, 0.5) == ("1",)           # too many places to try


def test_items_without_an_id_decontaminate(spark):
    item = " ".join(f"a{i}" for i in range(20))
    bench = spark.createDataFrame([(None, item), (1, "other words"), (None, None)], "item_id long, text string")
    rows = frame(spark, [(1, f"y {item} z", "s"), (2, "y z", "s")])
    assert [r.doc_id for r in decontam.decontaminate(rows, bench).collect()] == [2]


# ---------------------------------------------------------------- 5 substring dedup

def naive_substrings(corpus, window):
    low = {}
    for d, t, _ in corpus:
        if d is not None:
            w = words(t)
            for i in range(len(w) - window + 1):
                g = tuple(w[i:i + window])
                low[g] = min(d, low.get(g, d))
    out = Counter()
    for d, t, _ in corpus:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i:i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), kept] += 1
    return out


@pytest.mark.parametrize("hot_rows,shard_words", [(2000, 1 << 19), (2, 100)])
def test_substring_dedup(docs, corpus, hot_rows, shard_words):
    out = substring.dedup_substrings(docs, window=50, hot_rows=hot_rows, shard_words=shard_words)
    got = with_id(out, "n_words", "n_removed", F.col("kept").cast("string"))
    want = naive_substrings(corpus, 50)
    assert got == want and sum(n for (_, _, gone, _), n in want.items() if gone) > 10


def test_fm_index_by_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        window = rnd.choice([1, 2, 3, 5, 8, 9])
        seqs = [np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 25))]) for _ in range(rnd.randint(1, 10))]
        own = np.array([rnd.randint(0, 50) for _ in seqs])
        low = {}
        for s, o in zip(seqs, own):
            for i in range(len(s) - window + 1):
                g = tuple(s[i:i + window])
                low[g] = min(o, low.get(g, o))
        for s, found in zip(seqs, FMIndex(seqs, own, window).search(seqs)):
            assert found.tolist() == [low[tuple(s[i:i + window])] for i in range(len(s) - window + 1)]


# ---------------------------------------------------------------- 6 quality rules

def naive_quality(corpus, p):
    seen = defaultdict(set)

    def norm(line):
        line = line.strip(WS).translate(A_Z)
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line))
    for _, t, s in corpus:
        for line in (t.split("\n") if t is not None else []):
            if norm(line):
                seen[s, norm(line)].add(t)
    often = {k for k, v in seen.items() if len(v) > p.max_docs}
    out = Counter()
    for d, t, s in corpus:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        rep = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        cut = sum(len(words(x)) for x in (t or "").split("\n") if (s, norm(x)) in often)
        left = len(w) - cut
        kept = not failed and not (cut and (left < 20 or 100 * left < 30 * len(w)))
        out[d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed, cut, kept] += 1
    return out


def test_quality(docs, corpus):
    p = quality.QualityParams()
    got = with_id(quality.quality(docs, p), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cut_words", "kept")
    want = naive_quality(corpus, p)
    assert got == want
    assert any(cut and kept for *_, cut, kept in want) and any(cut and not kept and not f for *_, f, cut, kept in want)
    out = quality.apply_quality(docs, p)
    assert out.columns == docs.columns and out.count() == sum(n for k, n in want.items() if k[-1])
    assert out.filter("lower(text) like '%home%'").count() == 0


def letters(rnd, n):
    """n invented words without digits, which the line rule would take as equal."""
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(n))


def verdicts(spark, rows):
    return {r.doc_id: (r.cut_words, r.kept) for r in quality.quality(frame(spark, rows)).collect()}


def test_long_lines_count(spark):
    """A banner of 223 code points in all documents of a host, and a document of nothing else."""
    rnd = random.Random(1)
    banner = letters(rnd, 30)[:222] + "!"
    rows = [(i, f"{banner}\n{letters(rnd, 40)}", "h") for i in range(300)] + [(300, f"{banner}\n" * 3, "h")]
    got = verdicts(spark, rows)
    n = len(words(banner))
    assert len(banner) == 223
    assert {got[i] for i in range(300)} == {(n, True)} and got[300] == (3 * n, False)
    out = quality.apply_quality(frame(spark, rows)).collect()
    assert len(out) == 300 and not any(banner in r.text for r in out)


def test_copies_and_the_size_of_a_host_change_nothing(spark):
    """The same 80 pages alone, among 9,920 copies of one of them, and in a host of 9,920 other pages."""
    rnd = random.Random(2)
    pages = [(i, f"{letters(rnd, 30)}\nall about us and more", "h") for i in range(80)]
    copies = [(100 + i, pages[0][1], "h") for i in range(9920)]
    others = [(20000 + i, letters(rnd, 30), "h") for i in range(9920)]
    alone = verdicts(spark, pages)
    assert set(alone.values()) == {(5, True)}
    for more in (copies, others):
        got = verdicts(spark, pages + more)
        assert {i: got[i] for i in alone} == alone
    few = verdicts(spark, pages[:5] + copies)
    assert set(few.values()) == {(0, True)}          # a line of five documents stays, however often they are copied


# ---------------------------------------------------------------- 7 line dedup

def line_keys(t):
    return [x.strip(WS).translate(A_Z) for x in (t or "").split("\n")]


def naive_lines(corpus, min_docs, keep):
    where = defaultdict(set)
    for d, t, _ in corpus:
        for k in set(line_keys(t)) - {""}:
            where[k].add((d is None, d if d is not None else 0, t if d is None else ""))
    hot = {k for k, v in where.items() if len(v) >= min_docs}
    out = Counter()
    for d, t, _ in corpus:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, line_keys(t)) if k not in hot or (keep == "first" and min(where[k])[:2] == (d is None, d))]
        out[d, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return out


@pytest.mark.parametrize("min_docs,keep,filter_bytes", [(10, "none", 1 << 20), (3, "none", 64), (3, "first", 1 << 20)])
def test_line_dedup(docs, corpus, min_docs, keep, filter_bytes):
    out = line_dedup.dedup_lines(docs, min_docs=min_docs, keep=keep, broadcast_bytes=filter_bytes)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"]
    got = Counter(tuple(r) for r in out.select("doc_id", "text", "n_lines_", "n_dropped").collect())
    assert got == naive_lines(corpus, min_docs, keep)


def test_bloom_filters_miss_no_repeat(docs, corpus):
    """Every key in two documents passes the folded and the full filter."""
    for size in (1 << 20, 512):
        sus, _ = line_dedup.confirmed(docs, 2, 1, "doc_id", "text", size)
        got = {bytes(r.key).decode() for r in sus.select("key").distinct().collect()}
        n = Counter(k for _, t, _ in corpus for k in set(line_keys(t)) - {""})
        assert {k for k, c in n.items() if c > 1} <= got


# ---------------------------------------------------------------- 8 mixing

def naive_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            out.update({s: w[s] * level for s in free})
            break
        out.update({s: most * sizes[s] for s in over})
        free = [s for s in free if s not in over]
    return out


def test_mixing(docs, corpus):
    rows, placed = mixing.mix(docs, block_tokens=100, pieces=7)
    rows = rows.select(doc_id_of(F.col("id")).alias("doc_id"), "size", "source", "source_size", "target", "taken").collect()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((d, len(words(t)), s) for d, t, s in corpus)
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(words(t))
    want, taken = naive_targets(sizes, (3, 1, 2), 1.5, 2.0), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    # the schedule: full blocks but the last of a source, and every prefix near the weights
    slots = defaultdict(int)
    source = {}
    for r in placed.collect():
        slots[r.slot] += r.n_words
        source[r.slot] = r.source
    assert sorted(slots) == list(range(len(slots)))
    short = Counter(source[t] for t, n in slots.items() if n != 100)
    assert all(n <= 1 for n in short.values())
    share = Counter(source.values())
    for cut in range(20, len(slots), 20):
        now = Counter(source[t] for t in range(cut))
        assert all(abs(now[s] - cut * share[s] / len(slots)) < 4 for s in share)
    # what a document says of its slots is what the schedule says
    of_doc = defaultdict(set)
    for r in placed.select(doc_id_of(F.col("id")).alias("doc_id"), "th", "slot").collect():
        of_doc[r.doc_id, r.th].add(r.slot)
    for r in mixing.mix(docs, block_tokens=100)[0].select(doc_id_of(F.col("id")).alias("doc_id"), "th", "n_slots", "first_slot").collect():
        own = of_doc.get((r.doc_id, r.th), set())
        assert (r.n_slots, r.first_slot) == (len(own), min(own, default=None))
    again = mixing.mix(docs.repartition(5), block_tokens=100, pieces=7)[0]
    assert Counter((r.doc_id, r.taken) for r in rows) == with_id(again, "taken")


def test_many_sources_and_cells(spark, monkeypatch):
    """300 sources, most of one document; a source's cells from several rows; every prefix of the
    mix holds each source's share within two slots."""
    monkeypatch.setattr(mixing, "_CELLS", 7)
    rows = [(i, "w " * (5 + i % 40), f"s{i:03}") for i in range(300)] + [(1000 + i, "v " * 60, "hot") for i in range(150)] + [(5000, "x y", None)]
    out, placed = mixing.mix(frame(spark, rows), block_tokens=20)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = naive_targets(sizes, (3, 1, 2), 1.5, 2.0), Counter()
    for r in out.collect():
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    source = {r.slot: r.source for r in placed.collect()}
    share = Counter(source.values())
    assert sorted(source) == list(range(len(source))) and share["hot"] > 100
    for at in range(10, len(source), 10):
        now = Counter(source[t] for t in range(at))
        assert all(abs(now[s] - at * share[s] / len(source)) <= 2 + (s == "hot") for s in share)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 2 ** 40 + 15])
def test_multiplier_has_an_inverse(n):
    g = mixing.multiplier(n)
    assert n == 1 or (g * pow(g, -1, n)) % n == 1 and abs(g - n / mixing.GOLDEN) < 60


# ---------------------------------------------------------------- 9 license scan

def naive_scan(text, phrases, templates, threshold, size):
    def tok(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    w = tok(text)
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(tok(p))] == tok(p))
    step, found = size // 2, {}
    for label, t in templates.items():
        need = set(tok(t))
        best = max((len(need & set(w[i:i + size])) / len(need) for i in range(0, max(1, len(w)), step)), default=0)
        if best >= threshold - 1e-9:
            found[label] = round(best, 9)
    return len(w), tuple(places), tuple(sorted(found.items()))


def test_license_scan(spark):
    rnd = random.Random(9)
    templates = {"a": "one two three four five", "b": "two four six eight ten twelve one three five seven nine eleven", "c": "é ß 12", "d": "one"}
    phrases = {"cc by": "cc-by", "all rights reserved": "reserved", "one": "x"}
    v = "one two three four five six seven eight ten twelve é ß 12 cc by all rights reserved foo bar baz".split()
    v += ["qux"] * 40
    rows = [(i, rnd.choice([" ", "-", "\n", "_. "]).join(rnd.choice(v) for _ in range(rnd.randint(0, 90))).title(), "s") for i in range(150)]
    rows += [(None, "All RIGHTS\n\nreserved, CC-BY", None), (900, None, None), (901, "", None), (902, "cc " * 3000 + "by", None)]
    for threshold in (0.6, 0.8, 1.0):
        out = license_scan.license_scan(frame(spark, rows + rows[:3]), phrases, templates, threshold, block_words=12)
        got = Counter((r.doc_id, r.n_words, tuple(sorted((p.word, p.label) for p in r.places)), tuple(sorted((x.label, round(x.containment, 9)) for x in r.notices)))
                      for r in out.withColumn("doc_id", doc_id_of(F.col("id"))).collect())
        want = Counter((d, *naive_scan(t, phrases, templates, threshold, 24)) for d, t, _ in rows + rows[:3])
        assert got == want


def test_license_scan_finds_every_notice(spark):
    """A file with three copies of a notice, far apart, and a part of another at a block's edge."""
    rnd = random.Random(14)
    templates = {"a": "one two three four five", "b": "six seven eight nine ten"}
    w = ["qux"] * 150
    for at in (5, 60, 140):
        w[at:at + 5] = templates["a"].split()
    w[100:104] = "six seven eight nine".split()
    rows = [(1, " ".join(w), "s"), (2, None, "s")]
    rows += [(10 + i, " ".join(rnd.choice("one two three four five six seven eight nine ten qux qux".split()) for _ in range(rnd.randint(0, 80))), "s")
             for i in range(60)]
    got = {r.doc_id: [(x.label, x.word, round(x.containment, 9)) for x in r.blocks]
           for r in license_scan.license_scan(frame(spark, rows), {}, templates, 0.8, block_words=12)
           .withColumn("doc_id", doc_id_of(F.col("id"))).collect()}
    for d, text, _ in rows:
        v = (text or "").split()
        last = max(0, -(-(len(v) - 12) // 6))
        want = [(label, b * 6, round(n / 5, 9)) for label, t in templates.items() for b in range(last + 1)
                if (n := len(set(t.split()) & set(v[b * 6:b * 6 + 12]))) >= 4]
        assert got[d] == want
    spots = [x for x in got[1] if x[0] == "a"]
    assert all(any(at <= word + 12 and word <= at + 5 for _, word, _ in spots) for at in (5, 60, 140))


def found_labels(spark, texts, templates, **kw):
    out = license_scan.license_scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), {}, templates, **kw)
    return {r.id: [x.label for x in r.notices] for r in out.collect()}


def test_every_notice_names_its_own_license_only(spark):
    """Each registered notice alone, within prose, and with a word in five of a long one changed."""
    from tessera.llm.queries import NOTICES
    rnd = random.Random(15)
    notices = [(label, t) for label, ts in NOTICES.items() for t in ([ts] if isinstance(ts, str) else ts)]
    texts, want = [], []
    for label, t in notices:
        damaged = t.split()
        if len(damaged) > 40:
            for i in rnd.sample(range(len(damaged)), len(damaged) // 15):
                damaged[i] = "qux"
        for text in (t, f"{letters(rnd, 60)}\n# {t.upper()}\n{letters(rnd, 60)}", " ".join(damaged)):
            texts.append(text)
            want.append(label)
    for label, others in (("none", ["Licensed under terms of our own", "Released under the same roof", "version 2 of the story"]),
                          ("none", [f"Released {letters(rnd, 100)} under {letters(rnd, 100)} the MIT {letters(rnd, 100)} License"])):
        texts += others
        want += [label] * len(others)
    got = found_labels(spark, texts, NOTICES, tell_apart=True)
    for i, label in enumerate(want):
        if label == "none":
            assert got[i] == [], texts[i]
        else:
            assert label in got[i] and len(got[i]) == 1, (label, got[i], texts[i])
    both = found_labels(spark, ["Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0."], NOTICES, tell_apart=True)
    assert both[0] == ["cc-by-4.0", "cc-by-sa-4.0"]
    # what the threshold alone can't tell apart
    loose = found_labels(spark, ["Licensed under CC BY-SA 4.0"], {"nc": "Licensed under CC BY-NC 4.0", "sa": "Licensed under CC BY-SA 4.0"})
    assert loose[0] == ["nc", "sa"]


def test_telling_apart_by_brute_force(spark, monkeypatch):
    """``tell_apart`` against its definition, block by block."""
    monkeypatch.setattr(license_scan, "SHORT", 4)
    rnd = random.Random(16)
    v = [f"w{i}" for i in range(12)]
    templates = {f"l{k}": [" ".join(rnd.sample(v, rnd.randint(2, 9))) for _ in range(rnd.randint(1, 3))] for k in range(7)}
    flat = [(label, set(t.split()), next(s for s in (8, 16, 32) if s >= 2 * len(t.split()))) for label, ts in templates.items() for t in ts]
    texts = [" ".join(rnd.choice(v + ["qux"] * 3) for _ in range(rnd.randint(0, 70))) for _ in range(120)]
    want, gone = {}, 0
    for i, text in enumerate(texts):
        w, best = text.split(), {}
        for size in (8, 16, 32):
            for b in range(max(0, -(-(len(w) - size) // (size // 2))) + 1):
                n = Counter(w[b * size // 2:b * size // 2 + size])
                met = [(label, t, len(t & set(n)) / len(t)) for label, t, own in flat if own == size
                       and len(t & set(n)) >= (len(t) if len(t) < 4 else math.ceil(0.7 * len(t) - 1e-9))]
                for label, t, c in met:
                    near = [(o, d) for other, o, d in met if other != label and len(t & o) >= math.ceil(0.7 * len(t) - 1e-9)]
                    if any(d > c or d == c and len(o) > len(t) and any(n[x] == 1 for x in t) for o, d in near):
                        gone += 1
                    else:
                        best[label] = max(best.get(label, 0), round(c, 9))
        want[i] = sorted(best.items())
    assert gone > 20
    out = license_scan.license_scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), {}, templates, 0.7, block_words=8, tell_apart=True)
    assert {r.id: sorted((x.label, round(x.containment, 9)) for x in r.notices) for r in out.collect()} == want


# ---------------------------------------------------------------- 10 chat

def test_reply_trees(spark):
    rnd = random.Random(10)
    rows = []
    for tree in (1, 2, 3, None):
        n = rnd.randint(8, 30)
        rows += [(tree, i, rnd.choice([None, *range(i)]) if i else None, float(rnd.randint(0, 3)), rnd.choice(["user", "assistant", None]),
                  rnd.choice([None, "", "<|im_end|>", "a\\b<|", "hi\nthere", "\\p<\\n"])) for i in range(n)]
    rows += [(7, i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(70)]                    # a long chain
    rows += [(8, 1, 2, 0.0, "user", "loop"), (8, 2, 1, 0.0, "user", "loop"), (8, 3, 99, None, "us\ner", "orphan"), (8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    nodes = {(t, n): (p, s or 0.0, r or "", x or "") for t, n, p, s, r, x in rows if n is not None}

    def path(t, n):
        out = []
        while n is not None and (t, n) in nodes:
            if n in out:
                return None
            out.append(n)
            n = nodes[t, n][0]
        return out[::-1]
    want = {}
    for t in {t for t, _ in nodes}:
        parents = {p for (u, _), (p, *_) in nodes.items() if u == t}
        leaves = [p for u, n in nodes if u == t and n not in parents and (p := path(t, n))]
        leaves.sort(key=lambda p: (-sum(nodes[t, n][1] for n in p) / len(p), -len(p), p[-1]))
        for b, p in enumerate(leaves[:2], 1):
            want[t, b] = [(nodes[t, n][2], nodes[t, n][3]) for n in p]
    out = chat.format_trees(df, "tree", "node", "parent", "score", top_k=2).withColumn("t", doc_id_of(F.col("tree"))).collect()
    got = {}
    for r in out:
        turns, learnt = chat.read_back(r.formatted, [(s.start, s.end) for s in r.loss])
        assert learnt == "".join(x for role, x in turns if role == "assistant") and r.n_turns == len(turns)
        got[r.t, r.branch] = turns
    assert got == want
    assert chat.format_trees(df.limit(0), "tree", "node", "parent", "score").count() == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b<|im_start|>"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (2, 0, "assistant", "é" * 2000),
            (None, 5, "system", "x"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.c: r for r in chat.digests(chat.conversations(df)).withColumn("c", doc_id_of(F.col("tree"))).collect()}
    said = {1: [("user", "a"), ("user", "a"), ("assistant", "b<|im_start|>")], 2: [("", ""), ("assistant", "é" * 2000)], None: [("system", "x")], 3: [("assistant", "")]}
    assert set(got) == set(said)
    for c, turns in said.items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(chat.conversations(df.limit(0))).count() == 0


# ---------------------------------------------------------------- empty tables

def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "item_id long, text string")
    auto = token_counts.LongestMatch([b"a"])
    for out in (simhash.near_duplicates(empty), token_counts.token_counts(empty, auto), decontam.contaminated(empty, bench),
                decontam.decontaminate(empty, bench), substring.dedup_substrings(empty), quality.quality(empty), quality.apply_quality(empty),
                line_dedup.dedup_lines(empty), mixing.mix(empty)[0], mixing.mix(empty)[1], license_scan.license_scan(empty, {"a": "b"}, {"c": "d"})):
        assert out.count() == 0
