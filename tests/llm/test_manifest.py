"""The manifest of stored orders against a plain tree, and multiproofs against all single proofs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from restomart.llm import manifest as M
from restomart.sources.silver import conform
from restomart.sources.star_adapter import silver_from_star

ORDERS = ("id string, source string, location_id string, total_cents long, status string, part string, tree long, "
          "leaf string, place long, idx int")
FIELDS = ["id", "source", "total_cents", "status"]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, total):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*[field(v) for v in (row[0], row[1], total, row[4])])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path(tree, i):
    """(siblings of the run, whether they stand left) per level."""
    out = []
    for level in tree[:-1]:
        run = level[i // 2 * 2:i // 2 * 2 + 2]
        out.append((run[1 - i % 2] if len(run) == 2 else "", i % 2 == 1))
        i //= 2
    return out


def plain(rows, changed):
    """(id, leaf, subroot, root, proof, folded root, verified) of every row."""
    by_source, texts = {}, lambda x: (x is not None, (x or "").encode())
    for row in rows:
        total = row[3] + 1 if row[3] is not None and changed(row) else row[3]
        by_source.setdefault(row[1], []).append((texts(row[0]), leaf(row, row[3]), leaf(row, total), row[0]))
    sources = sorted(by_source, key=texts)
    trees = {s: levels([x[1] for x in sorted(by_source[s])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for rank, source in enumerate(sources):
        for place, (_, stored, received, key) in enumerate(sorted(by_source[source])):
            way, folded = path(trees[source], place) + path(top, rank), received
            for beside, left in way:
                folded = sha(beside, folded) if left else sha(folded, beside)
            out.append((key, source, stored, trees[source][-1][0], top[-1][0], sha(*[b for b, _ in way]), folded,
                        folded == top[-1][0]))
    return sorted(out, key=str)


def orders(sizes, seed=3):
    rng, out = random.Random(seed), []
    for source, n in sizes.items():
        for i in range(n):
            total = None if rng.random() < 0.1 else rng.randrange(9_000)
            out.append((f"o{rng.randrange(10 ** 6):06}", source, "loc", total, rng.choice(["completed", "", None, "é🙂"]),
                        "x", 1, "y", 2, 3))
    return out


def verified(spark, rows):
    changed = F.substring("id", -1, 1) == "3"
    total = F.when(changed, F.col("total_cents") + 1).otherwise(F.col("total_cents"))
    return M.order_manifest(spark.createDataFrame(rows, ORDERS), FIELDS, {"total_cents": total})


@pytest.mark.parametrize("part,first,more", [(7, 4, 2), (1, 3, 1), (64, 5, 3), (10_000, 22, 12)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, part, first, more):
    monkeypatch.setattr(M, "PART_LEAVES", part)
    monkeypatch.setattr(M, "FIRST_STEP", first)
    monkeypatch.setattr(M, "NEXT_STEP", more)
    rows = orders({"toast": 101, "doordash": 1, "square": 33, None: 6, "": 2, "é": 64})
    rows += [rows[0]] * 5 + [(None, "toast", "l", 5, "open", *rows[0][5:]), (None, "toast", "l", None, None, *rows[0][5:]),
                             (rows[1][0], "toast", "l", 7, "x" * 100_000, *rows[0][5:])]
    found = verified(spark, rows)
    assert found.columns == ["id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain(rows, lambda r: (r[0] or "").endswith("3"))
    assert 0 < sum(not r[-1] for r in got) < 50


def test_manifest_of_small_tables(spark):
    assert verified(spark, []).count() == 0
    lone = orders({"toast": 1})
    row = verified(spark, lone).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    many = orders({f"s{i:03}": 1 for i in range(150)})  # a source for every order
    got = sorted((tuple(r) for r in verified(spark, many).collect()), key=str)
    assert got == plain(many, lambda r: r[0].endswith("3"))


def test_manifest_of_whole_silver_orders(spark, sf_dir):
    found = M.order_manifest(conform(silver_from_star(spark, sf_dir).orders, "orders"))
    assert found.filter("not verified").isEmpty() and found.select("root").distinct().count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 31, 32, 33])
def test_multiproof_is_the_least_union(n):
    rng = random.Random(n)
    for _ in range(20):
        known = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        tree = levels([sha(str(i)) for i in range(n)])
        covered = lambda level, i: any(k >> level == i for k in known)
        wanted = {(level, k >> level ^ 1) for k in known for level in range(len(tree) - 1)
                  if k >> level ^ 1 < len(tree[level]) and not covered(level, k >> level ^ 1)}
        got = M.missing_coordinates(known, n)
        assert len(got) == len(set(got)) and set(got) == wanted
        held = {0: {k: tree[0][k] for k in known}}
        for level, i in got:
            held.setdefault(level, {})[i] = tree[level][i]
        M._derived(held, n, 99)
        assert held[len(tree) - 1][0] == tree[-1][0]
        assert all(M._path(held, k, n) == path(tree, k) for k in known)
