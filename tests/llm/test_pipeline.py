"""The corpus pipeline against plain versions of its stages, and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F
from samples import groups, hits, prose

import corpus_pipeline
from restomart.llm import queries as Q
from restomart.llm.language import UNKNOWN

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DAYS = "der die und nicht ein ist auf mit von zu".split()


def german(seed, n):
    return " ".join(DAYS[int(w[-1])] + w[:2] for w in prose(seed, n).split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    question = prose(900, 20)
    rows = [(i, prose(i, 60), "en") for i in range(40)] + [(40 + i, german(i, 60), "de") for i in range(40)]
    rows += [(100, prose(1, 60), "en"), (101, prose(2, 59) + " other", "en"), (102, f"{prose(77, 30)} {question}", "en"),
             (103, f"{prose(78, 30)} write to guest@host.example.com or +1 (017) 555-7713", "en"), (104, None, "en"),
             (105, "1234 !!", "en"), (106, "", None), (3, prose(3, 60), "en"), (None, prose(79, 40), "en")]
    docs = spark.createDataFrame([(i, t, g, "src0", len(t or "")) for i, t, g in rows], SCHEMA)
    docs.coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, question


def test_stages_against_plain_versions(spark, folder, tmp_path):
    root, rows, question = folder
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    columns = SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
    assert all(seen[n].columns == columns for n in names[:-1])

    ids = lambda n: sorted((r["doc_id"] for r in seen[n].collect()), key=str)
    kept = [(i, t) for i, t, _ in rows if i not in (104, 105, 106)]
    assert ids(names[0]) == sorted((i for i, _ in kept), key=str)
    component = groups(kept, 5)
    firsts = sorted({i for i, _, c in component if i == c} | {None}, key=str)
    assert ids(names[1]) == firsts
    texts = {r["doc_id"]: r["text"] for r in seen[names[1]].collect()}
    dirty = {i for i, _, n, _ in hits(list(texts.items()), [(1, question)], 10) if n}
    assert dirty == {102} and ids(names[2]) == [i for i in firsts if i not in dirty]
    clean = {r["doc_id"]: r for r in seen[names[3]].collect()}
    assert clean[103]["text"].endswith("write to [email] or [phone]")
    assert all(r["text"] == texts[i] for i, r in clean.items() if i != 103)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    packed = seen[names[4]]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(clean)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert full.filter("n <> m or n > 1024").isEmpty()
    assert corpus_pipeline.run(spark, root).count() == packed.count()


def test_language_stage_rejects_by_the_prediction(spark):
    rng = random.Random(8)
    mixed = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(n))
    rows = [(i, text(i, n), lang) for text, lang, first in ((prose, "en", 0), (german, "de", 1_000))
            for i, n in zip(range(first, first + 400), [1, 3, 10, 60] * 100)]
    unknown = [(5_000, mixed("жщыбцдфгяэюи", 60), None), (5_001, mixed("qxzjvkwqxy", 60), None),
               (5_002, mixed("人生自由尊严权利平", 60), None)]
    clean = [(6_000 + i, f(7_000 + i, n), None) for i, (f, n) in enumerate(
        [(prose, 3), (prose, 10), (prose, 60), (german, 3), (german, 10), (german, 60)])]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows + unknown + clean], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert not kept & {i for i, _, _ in unknown}
    assert {i for i, _, _ in clean} <= kept and len(kept & {i for i, _, _ in rows}) >= 0.99 * len(rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == docs.count()


def test_pipeline_of_nothing(spark, folder, tmp_path):
    root, _, _ = folder
    empty = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, root)
        assert empty.count() == 0


COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_html_text": "page_id url text n_chars",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_near_duplicates": "doc_id n_shingles component_id kept",
    "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit", "op9_quality": "doc_id held_out score predicted",
    "op10_nearest_neighbours": "query_id rank vec_id score",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_set_join": "doc_id n_shingles component_id",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified"}


def test_queries_have_the_agreed_columns(spark, sf_dir):
    assert set(COLUMNS) == set(Q.QUERIES)
    for name, query in Q.QUERIES.items():
        found = query(spark, sf_dir)
        wanted = COLUMNS[name].split()
        assert found.columns[:len(wanted)] == wanted, name


def test_language_and_quality_queries_on_their_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = Q.op4_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    assert found.filter(F.col("lang_pred") == UNKNOWN).isEmpty()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = Q.op9_quality(spark, sf_dir).filter("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9
