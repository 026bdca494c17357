"""The exact join of messages by R-trees against all pairs."""

import random

import numpy as np
import pytest
from samples import AWKWARD, groups, messages, prose

from restomart.llm import set_join as J

key = lambda row: tuple((x is None, x) for x in row)


def family(seed, size, edits, words=120):
    rng, base, out = random.Random(seed), prose(seed, words).split(), []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"edit{seed}x{i}y{rng.randrange(99)}"
        out.append(" ".join(own))
    return out


def chain(n, words=60):
    """Each text shares enough with its neighbours only."""
    w = prose(77, words + 2 * n).split()
    return [" ".join(w[2 * i:2 * i + words]) for i in range(n)]


def found(spark, contents, **options):
    out = J.linked_messages(messages(spark, contents).repartition(5), **options)
    assert out.columns == ["id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=key)


def test_linked_messages_equal_all_pairs(spark):
    texts = [t for s in range(6) for t in family(s, 12, 5)] + [prose(90 + i, 30) for i in range(10)] + chain(12)
    texts += [" ".join(prose(5, 9).split()[:n]) for n in range(1, 10)]
    contents = list(enumerate(texts, 10)) + AWKWARD + [(500, texts[0].upper()), (501, texts[0].replace(" ", "\n "))]
    assert found(spark, contents) == sorted(groups(contents, 5), key=key)


def test_crowds_in_one_cell_take_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "COUNTERS", 64)  # so that shared passages are not told from rare ones
    shared = prose(8, 40)
    contents = list(enumerate(family(7, 60, 9) + [f"{shared} {prose(300 + i, 12)}" for i in range(60)] + chain(30)))
    assert found(spark, contents) == sorted(groups(contents, 5), key=key)


def test_links_of_a_crowd_grow_with_its_rows(spark, monkeypatch):
    listed, plain = [], J.connected_components
    monkeypatch.setattr(J, "ROUNDS", 0)  # so that the last search meets whole crowds
    monkeypatch.setattr(J, "connected_components", lambda edges: listed.append(edges.count()) or plain(edges))
    for size in (25, 100):
        contents = list(enumerate(family(11, size, 1)))
        assert found(spark, contents) == sorted(groups(contents, 5), key=key)
    assert listed[1] < 8 * listed[0]  # 16 times if all pairs are listed


@pytest.mark.parametrize("two_tiles", [False, True])
def test_links_of_two_tiles_join_what_all_their_pairs_join(two_tiles):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, 90), dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 6])[:rng.integers(76, 91)], rng.integers(
        0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])) for i in range(150)]
    of = [b"%d" % (i % 40) for i in range(150)]
    rows = [(b"k%03d" % i, len(s), c, J.point(s)) for i, (s, c) in enumerate(zip(sets, of))]
    codes, cut = {}, 70 if two_tiles else 150
    one = J._Tile(rows[:cut], codes)
    two = J._Tile(rows[cut:], codes) if two_tiles else one
    got = J._joining(one, two, (sets[:cut], sets[cut:]), 80)
    pairs = [(i, j) for i in range(150) for j in range(i) if not two_tiles or (j < cut <= i)]
    similar = {(i, j) for i, j in pairs if of[i] != of[j]
               and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

    def joined(links):
        label = {c: c for c in of}
        for i, j in links:
            x, y = label[of[i]], label[of[j]]
            label = {c: x if at == y else at for c, at in label.items()}
        return {frozenset(c for c in of if label[c] == at) for at in label.values()}
    got = [tuple(sorted((int(x[1:]), int(y[1:])), reverse=True)) for x, y in got]
    assert set(got) <= similar and joined(got) == joined(similar) and len(got) < 40 < len(similar)


def test_cells_within_others_leave(spark):
    cells = {1: "abcd", 2: "abc", 3: "abcd", 4: "ce", 5: "ab", 6: "ef", 7: "f", 8: "cd"}
    rows = spark.createDataFrame([(c, k.encode()) for c, keys in cells.items() for k in keys], "cell long, set_key binary")
    left = {r["cell"] for r in J._widest(rows).select("cell").distinct().collect()}
    meet = lambda of: {(x, y) for c in of for x in cells[c] for y in cells[c]}
    assert left == {3, 4, 6} and meet(left) == meet(cells)


def test_other_widths_and_shares(spark):
    contents = list(enumerate(family(3, 30, 12, 60)))
    for width, percent in ((2, 50), (1, 95), (5, 100)):
        assert found(spark, contents, width=width, percent=percent) == sorted(groups(contents, width, percent), key=key)


def test_linked_messages_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (1, ""), (None, " ")]) == [(1, 0, 1), (1, 0, 1), (None, 0, None)]
    assert found(spark, [(None, "a b"), (None, "a b")]) == [(None, 1, None)] * 2


@pytest.mark.parametrize("sizes", [(40,), (300, 420), (6, 2_000), (1, 3, 9)])
def test_tree_finds_what_the_bound_allows(sizes):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) * np.uint64(2) for n in sizes]
    sets = []
    for i in range(200):
        b = base[i % len(base)]
        own = np.concatenate([rng.permutation(b)[:max(1, len(b) - rng.integers(0, len(b) // 5 + 1))],
                              rng.integers(0, 1 << 63, rng.integers(0, len(b) // 5 + 1), dtype=np.uint64)])
        sets.append(np.unique(own))
    points = [J.point(s) for s in sets]
    points = J.folded(points, min(map(len, points)))
    size, of = np.array([len(s) for s in sets]), np.arange(200) % 7
    tree = J.CountTree(points, size, of, 80)
    a, b, bound = tree.search(points, size, of)
    least = np.minimum(points[:, None], points[None]).sum(axis=2)
    wanted = (180 * least >= 80 * (size[:, None] + size)) & (100 * size[:, None] >= 80 * size) & (
        100 * size >= 80 * size[:, None]) & (of[:, None] != of)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(wanted))))
    assert (bound == least[a, b]).all()
    assert all(least[i, j] >= len(np.intersect1d(sets[i], sets[j])) for i in range(0, 200, 9) for j in range(200))


def test_prefixes_of_similar_sets_meet():
    rng, levels = np.random.default_rng(2), np.zeros(J.COUNTERS, np.uint8)
    levels[rng.integers(0, J.COUNTERS, 9_000)] = 5
    for n in (5, 9, 40, 333):
        for _ in range(30):
            both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            extra = np.unique(rng.integers(0, 1 << 63, n // 4, dtype=np.uint64))
            one, two = both, np.union1d(both, extra) if rng.random() < 0.5 else both[:-(-4 * len(both) // 5)]
            if 100 * len(np.intersect1d(one, two)) >= 80 * len(np.union1d(one, two)):
                assert set(J.prefix(one, levels, 80)) & set(J.prefix(two, levels, 80))


def test_set_join_on_the_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(400).selectExpr(
        "concat(conv_id, '-', turn) AS id", "role", "text AS content")
    got = sorted((tuple(r) for r in J.linked_messages(table).collect()), key=key)
    assert got == sorted(groups([(r["id"], r["content"]) for r in table.collect()], 5), key=key)
