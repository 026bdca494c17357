"""What the catalog queries leave on disk while they run."""

import random
import time
from functools import reduce
from glob import glob
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from restomart import session
from restomart.operators import catalog, fuzzy
from restomart.plans import normalize
from restomart.sources import exports
from test_fuzzy import noisy_names


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob(f"{folder}/**/shuffle_*.data", recursive=True)}


def test_shuffle_files_go_with_the_step(spark):
    before = shuffle_files(spark)
    with session.freed_shuffles(spark):
        found = session.cut_lineage(spark.range(5000).groupBy(F.col("id") % 7).count())
        for _ in range(100):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
    assert spark.conf.get(session.FREE_SHUFFLES, None) != "true"
    assert found.count() == 7


def test_steps_are_stored_compressed(spark):
    names = spark.range(20_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    found = session.cut_lineage(names)
    size = sum(Path(x.removeprefix("file://")).stat().st_size for x in found.inputFiles())
    assert size < 20_000 * 50  # a key alone has 64 characters
    assert found.exceptAll(names).isEmpty() and found.count() == 20_000


@pytest.mark.parametrize("k", [2, 3, 5])
def test_shares_hold_every_pair_and_no_signature_twice(spark, k):
    rng = random.Random(k)
    left = spark.createDataFrame([(x,) for x in noisy_names(rng, 60)], "text string")
    right = spark.createDataFrame([(x,) for x in noisy_names(rng, 60)], "index_text string")
    parts = fuzzy.shares(right, "index_text", k)
    pairs = lambda share: {tuple(r) for r in fuzzy.near_pairs(
        left, right, k, "text", "index_text", share=share).select("text", "index_text", "distance").collect()}
    assert len(parts) > 1 and set.union(*map(pairs, parts)) == pairs(None)
    signed = [right.select(F.explode(fuzzy.index_signatures("index_text", k, x)).alias("s")).distinct() for x in [None, *parts]]
    together = reduce(DataFrame.unionByName, signed[1:])
    assert together.count() == signed[0].count() == together.distinct().count()


def test_pairs_are_joined_share_by_share(spark, monkeypatch):
    asked = []
    near = fuzzy.near_pairs
    monkeypatch.setattr(fuzzy, "near_pairs", lambda *a, share=None, **b: asked.append(share) or near(*a, share=share, **b))
    names = spark.createDataFrame([("espresso",), ("expresso",), ("green tea",)], "text string")
    products = spark.createDataFrame([("p1", 1, "espresso x"), ("p2", 2, "green teas")],
                                     "product_id string, product_rank int, product_text string")
    found = {tuple(r) for r in catalog.find_products(names, products).collect()}
    assert found == {("espresso", "p1"), ("expresso", "p1"), ("green tea", "p2")}
    assert len(set(asked)) > 1 and None not in asked


def test_lone_rows_of_a_block_are_not_signed(spark, monkeypatch):
    signed = []
    inner = fuzzy._signed
    monkeypatch.setattr(fuzzy, "_signed", lambda probes, *a: signed.append(probes.count()) or inner(probes, *a))
    rows = [(0, "tea", "a"), (1, "tea x", "b"), (2, "soup", "c"), (3, "teas", "a"), (4, "lone", None)]
    items = spark.createDataFrame(rows, "rank bigint, text string, block string")
    found = {r["rank"]: r["parent"] for r in fuzzy.first_earlier_neighbour(items, 2, "block").collect()}
    assert found == {0: None, 1: None, 2: None, 3: 0, 4: None}
    assert max(signed) == 2


def test_only_exports_read_twice_land(spark):
    frame = spark.range(3)
    found = exports.landed(exports.Exports(frame, frame, exports.SquareExport(None, frame, frame, frame)), "toast", "orders")
    stored = lambda df: bool(df.inputFiles())
    assert stored(found.toast) and stored(found.square.orders)
    assert found.doordash is frame and found.square.payments is frame and found.square.locations is None


def test_square_lines_keep_their_products(spark):
    """Also a line of a variation without a name, and one of no known variation."""
    shelf = spark.createDataFrame([("i1", "Lg", "p1", "v1"), ("i1", None, "p1", None)],
                                  "catalog_id string, catalog_label string, product_id string, variation_id string")
    lines = spark.createDataFrame([(1, "i1", "Lg"), (2, "i1", None), (3, None, None)], "n int, catalog_id string, catalog_label string")
    found = normalize.attach_square_products(lines, shelf).select("n", "product_id", "variation_id")
    assert sorted(map(tuple, found.collect())) == [(1, "p1", "v1"), (2, "p1", None), (3, None, None)]


def test_attached_lines_are_stored_in_slices(spark, sf_dir):
    found = entry_module.queries()["j07_attached_lines"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert found.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_last_entry_of_a_key_names_its_product(spark):
    """Also where a group has no product or a name no group."""
    rows = [(0, 0, "s1", "Tea"), (1, 1, "s2", "tea"), (2, 1, "s1", "Soup"), (3, None, "s3", "Lost")]
    grouped = spark.createDataFrame(rows, "rank bigint, group_rank bigint, source_id string, original_name string").withColumns(
        {"base": F.col("original_name"), "variations": F.lit(None).cast(catalog.NO_VARIATIONS)})
    products = spark.createDataFrame([("p0", 0), ("p1", 1)], "id string, product_rank bigint")
    xref = catalog.product_xref(grouped, products)
    assert sorted(map(tuple, xref.select("kind", "key", "product_id").collect())) == [
        ("id", "s1", "p1"), ("id", "s2", "p1"), ("name", "soup", "p1"), ("name", "tea", "p1")]


def landed_tables(spark, query, sf_dir, monkeypatch):
    names = []
    monkeypatch.setattr(exports, "stored", lambda df, name: names.append(name) or session.stored(df, name))
    assert entry_module.queries()[query](spark, sf_dir).count() > 0
    return names


def test_aliases_land_what_they_read_twice(spark, sf_dir, monkeypatch):
    assert sorted(landed_tables(spark, "n17_aliases", sf_dir, monkeypatch)) == ["export-doordash", "export-toast"]


def test_shelf_labels_land_nothing(spark, sf_dir, monkeypatch):
    assert landed_tables(spark, "n15_shelf_labels", sf_dir, monkeypatch) == []


def test_described_products_free_their_shuffles(spark, sf_dir, monkeypatch):
    before = shuffle_files(spark)
    steps = []
    monkeypatch.setattr(session, "stored", lambda df, name, inner=session.stored: steps.append(
        spark.conf.get(session.FREE_SHUFFLES, None)) or inner(df, name))
    entry_module.queries()["a11_described_products"](spark, sf_dir)
    assert len(steps) > 10 and set(steps) == {"true"}
    assert spark.conf.get(session.FREE_SHUFFLES, None) != "true"
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
