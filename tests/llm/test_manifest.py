"""The Merkle manifest against a recursive version of its rule."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.queries import op11_merkle

from .conftest import frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def naive_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i:i + 3]) for i in range(0, len(x), 3)])
    return levels


def naive_path(levels, i):
    for x in levels[:-1]:
        first = i - i % 3
        yield x[first:first + 3], i - first
        i //= 3


def naive_rows(rows):
    """rows (doc_id, source, lang, n_chars, text) -> Counter of the query's rows."""
    def leaf(r, text):
        return H(*[field(v) for v in (*r[:4], text)])
    trees = defaultdict(list)
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        short = r[4].replace("\n", "") if touched and r[4] is not None else r[4]
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, short), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: naive_levels([x[2] for x in sorted(trees[s])]) for s in order}
    forest = naive_levels([built[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, x in enumerate(sorted(trees[s])):
            proof, at = [], x[3]
            for run, slot in [*naive_path(built[s], i), *naive_path(forest, k)]:
                proof += run[:slot] + run[slot + 1:]
                at = H(*run[:slot], at, *run[slot + 1:])
            root = forest[-1][0]
            out[x[4], x[2], built[s][-1][0], root, H(*proof), at, at == root] += 1
    return out


def naive_log(n):
    """(level, index) in the order of a recursive postorder walk."""
    top = merkle.height(n)

    def walk(level, index):
        if level:
            for j in range(3 * index, min(3 * index + 3, -(-n // 3 ** (level - 1)))):
                yield from walk(level - 1, j)
        yield level, index
    return list(walk(top, 0))


@pytest.mark.parametrize("n", [*range(1, 41), 80, 81, 82, 242, 243, 244, 250])
def test_positions_are_the_postorder(n):
    assert [merkle.position(lv, j, n) for lv, j in naive_log(n)] == list(range(len(naive_log(n))))
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = naive_levels([x.hex() for x in leaves])
    assert [x.hex() for x in merkle.completion_order(leaves, merkle.height(n))] == [levels[lv][j] for lv, j in naive_log(n)]


def source_rows(seed, n, sources):
    rnd = random.Random(seed)
    return [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, i]), f"a\nb{i}" if i % 3 else "é\n") for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_through_any_number_of_layers(spark, levels):
    """A hot source, sources of one row, many sources: block sizes of 3, 9 and 2,187."""
    rows = source_rows(3, 150, ["hot"] * 30 + [f"s{i}" for i in range(40)] + [None])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    leaves = df.select("source", "doc_id", merkle.leaf({c: df[c] for c in merkle.COLUMNS}).alias("leaf"))
    m = merkle.build(leaves, levels)
    out = merkle.with_folded_root(merkle.prove(m, levels), "digest", "folded").collect()
    want = naive_rows([r for r in rows])
    assert {r[3] for r in want} == {m.root}
    got = Counter((r.doc_id, bytes(r.digest).hex(), bytes(r.subroot).hex(), H(bytes(r.siblings).hex())) for r in out)
    assert got == Counter({(w[0], w[1], w[2], w[4]): c for w, c in want.items()})
    assert {bytes(r.folded).hex() for r in out} == {m.root}
    # every node of every tree stands once, at its place in the log
    log = defaultdict(dict)
    for r in merkle.log_rows(m.layers, levels).collect():
        assert r.place not in log[r.tree]
        log[r.tree][r.place] = bytes(r.digest).hex()
    sizes = {r.tree: (r.n, bytes(r.subroot).hex()) for r in m.trees.collect()}
    assert set(sizes) == set(log)
    for t, (n, subroot) in sizes.items():
        assert sorted(log[t]) == list(range(len(naive_log(n)))) and log[t][len(log[t]) - 1] == subroot


def test_a_changed_row_or_order_does_not_verify(spark):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    nodes = b"".join(merkle.completion_order(leaves, 3))
    root = nodes[-32:]
    for i, x in enumerate(leaves):
        path = merkle.path_in_segment(nodes, 11, 3, i)
        assert merkle.fold(x, *path) == root
        assert merkle.fold(leaves[(i + 1) % 11], *path) != root


def test_query_by_brute_force(spark, corpus, tmp_path):
    rows = [(i, s, "en", len(t or ""), t) for i, t, s in corpus]
    rows += [(900 + i, "s1", None, None, f"x\n{i}\n") for i in range(9)] + [(-5, "", "", -1, "\n"), (-5, "", "", -1, "\n")]
    df = spark.createDataFrame([(*r, "x", 1, 2, b"3") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, "
                               "tree int, digest binary")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op11_merkle(spark, str(tmp_path)).collect())
    assert got == naive_rows(rows)
    assert {r[-1] for r in got} == {True, False}


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_merkle(spark, str(tmp_path))
    assert out.count() == 0 and "folded_root" in out.columns
    m = merkle.build(empty.select("source", "doc_id", F.lit(b"").alias("leaf")))
    assert m.root is None and m.trees.count() == 0
