"""Near-duplicates, contamination, personal data, language, quality, tokens and packing of messages."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from samples import AWKWARD, LONG, groups, hits, messages, prose

from restomart.llm import near_duplicates as N
from restomart.llm import pii
from restomart.llm.bin_completion import complete_bins, lower_bound
from restomart.llm.components import connected_components
from restomart.llm.contamination import find_contamination
from restomart.llm.language import identify_language
from restomart.llm.packing import byte_tokenizer, pack_messages
from restomart.llm.quality import score_quality, statistics
from restomart.llm.token_counts import counter, message_tokens, whole_tokens

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
key = lambda row: tuple((x is None, x) if not isinstance(x, list) else (False, str(x)) for x in row)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def family(seed, size, edits):
    """Near copies of one text: each changes some words of its own."""
    rng, base, out = random.Random(seed), prose(seed, 120).split(), []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"edit{seed}x{i}y{rng.randrange(99)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    texts = [t for s in range(6) for t in family(s, 12, 5)] + [prose(90 + i, 30) for i in range(10)]
    contents = list(enumerate(texts, 10)) + AWKWARD + [(500, texts[0].upper()), (501, texts[0].replace(" ", "\n "))]
    found = N.near_duplicates(messages(spark, contents), width=4)
    assert rows(found, "id", "n_shingles", "component_id") == sorted(groups(contents, 4), key=key)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found.collect())
    assert found.columns == ["id", "n_shingles", "component_id", "kept"]


def test_near_duplicates_of_a_crowded_bucket_need_more_than_stars(spark):
    contents = list(enumerate(family(7, 60, 9)))
    found = N.near_duplicates(messages(spark, contents), width=4)
    assert rows(found, "id", "n_shingles", "component_id") == sorted(groups(contents, 4), key=key)


def test_near_duplicates_of_nothing(spark):
    assert N.near_duplicates(messages(spark, [])).count() == 0
    assert rows(N.near_duplicates(messages(spark, [(1, None), (1, "")])), "id", "component_id", "kept") == [
        (1, 1, True), (1, 1, True)]


def test_sketch_agrees_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        both = np.unique(rng.integers(0, 1 << 63, 12, dtype=np.uint64))
        one, two = both[:11], both[1:]
        same.append((N.sketch(one) == N.sketch(two)).mean())
    assert abs(np.mean(same) - 10 / 12) < 0.05


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("s00", f"s{i:02}") for i in range(1, 30)]
    found = connected_components(spark.createDataFrame([*edges, (None, "x"), ("y", "y")], "a string, b string"))
    assert {r["component"] for r in found.collect() if r["vertex"] < "s"} == {"000"}
    assert {r["component"] for r in found.collect() if r["vertex"] >= "s"} == {"s00"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


QUESTIONS = [(1, prose(50, 25)), (2, "Short, Question five WORDS"), (3, None), (4, "..."), (None, prose(51, 15)),
             (1, prose(50, 25)), (20, prose(52, 14))]


def test_contamination_equals_all_windows(spark):
    q = dict((k, t) for k, t in QUESTIONS if k is not None)
    contents = AWKWARD + [
        (20, f"{prose(60, 30)} {q[1]} {prose(61, 8)}"), (21, " ".join(q[1].split()[3:14]).upper() + "!"),
        (22, " ".join(q[1].split()[:9])), (23, "short -- question FIVE words; short question five words"),
        (24, prose(51, 15)), (25, q[20] + " " + q[20]), (25, q[20]), (26, "É" + q[20]), (None, q[20])]
    found = find_contamination(messages(spark, contents), messages(spark, QUESTIONS))
    got = rows(found, "id", "n_words", "n_hit", "items")
    assert got == sorted(hits(contents, QUESTIONS, 10), key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found.collect())


def test_contamination_near_phrases(spark):
    w = prose(50, 25).split()
    torn = " ".join(w[:6] + ["other"] + w[7:13])
    found = find_contamination(messages(spark, [(1, torn)]), messages(spark, [(1, prose(50, 25))])).first()
    assert (found["n_hit"], found["contaminated"]) == (0, False) and found["n_near"] > 0


def test_contamination_of_nothing(spark):
    assert find_contamination(messages(spark, []), messages(spark, QUESTIONS)).count() == 0
    plain = find_contamination(messages(spark, AWKWARD), messages(spark, []))
    assert plain.filter("contaminated or size(items) > 0").count() == 0 and plain.count() == len(AWKWARD)


PERSONAL = [
    (30, "Mail a.b@c.de, or x@y.z_q@r.st; no: a@b, @c.d"), (31, "from 10.0.0.255 and 256.1.1.1, 1.2.3.4.5.6.7.8 "),
    (32, "card 4111 1111 1111 1111 or 4111-1111-1111-1112"), (33, "call +1 (017) 555-7713. or +49.30.1234567, +12"),
    (34, "🙂 é x@y.zz +1 (017) 555-7713"), (35, "9" * 5_000 + " " + "a." * 5_000 + "b@c.d" + ".e" * 3_000)]


def plain_spans(text):
    valid = {"email": lambda v, d: True, "ip": lambda v, d: all(int(p) <= 255 for p in v.split(".")),
             "card": lambda v, d: 14 <= len(d) <= 19 and sum(
                 sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0,
             "phone": lambda v, d: 10 <= len(d) <= 15}
    shape = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return sorted((m.start(), pii.KINDS.index(k), m.end(), m.group()) for k in pii.KINDS
                  for m in re.finditer(shape[k], text or "") if valid[k](m.group(), re.sub("[^0-9]", "", m.group())))


def test_exact_personal_data_equals_plain_patterns(spark):
    contents = AWKWARD + PERSONAL
    found = pii.find_personal_data(messages(spark, contents), None)
    got = sorted(((r["content"], [tuple(s) for s in r["base"]]) for r in found.collect()), key=str)
    assert got == sorted(((t or "", plain_spans(t)) for _, t in contents), key=str)
    text = found.select("id", pii.spans_text(F.col("base")).alias("t")).filter("id = 33").first()["t"]
    assert text == "phone:5:22,phone:27:41"
    assert pii.find_personal_data(messages(spark, []), None).count() == 0


def personal(n):
    rng = random.Random(5)
    for i in range(n):
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))  # noqa: E731,B023
        yield (i, f"{prose(i, 5)} mail guest{i}@host{i % 7}.example.com, tel +1 ({d(3)}) 555-{d(4)} from "
                  f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} order {d(16)} "
                  f"version {rng.randrange(300, 999)}.{d(2)}.{d(1)}.{d(3)} {prose(i + 1, 4)}")


def test_trees_add_other_spellings_and_leave_look_alikes(spark):
    train = messages(spark, personal(400))
    detector = pii.fit_detector(train)
    assert detector.thresholds
    probe = [(1, "mail guest7 (at) host3 (dot) example (dot) com or tel 1 (017) 555-7713 please"),
             (2, "order 1234567890123456 version 999.12.1.345"), (3, prose(3, 50))]
    found = {r["id"]: r for r in pii.find_personal_data(messages(spark, probe), detector).collect()}
    assert found[1]["base"] == [] and found[1]["added"]
    assert all(not found[i]["added"] for i in (2, 3))
    train = pii.find_personal_data(train, detector)
    assert train.filter("size(base) < 3").count() == 0
    overlaps = F.exists("added", lambda a: F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    assert train.filter(overlaps).count() == 0


def test_other_spellings_in_the_training_texts_are_found(spark):
    contents = []
    for i, text in personal(400):
        if i % 20 == 0:
            text = text.replace("@", " (at) ").replace(".example.com", " (dot) example (dot) com")
        if i % 20 == 1:
            text = text.replace("tel +", "tel ")
        contents.append((i, text))
    train = messages(spark, contents)
    found = {r["id"]: {pii.KINDS[s["kind"]] for s in r["added"]} for r in pii.find_personal_data(
        train, pii.fit_detector(train)).collect()}
    assert sum("email" in found[i] for i in range(0, 400, 20)) >= 18
    assert sum("phone" in found[i] for i in range(1, 400, 20)) >= 18
    assert sum(bool(found[i]) for i in found if i % 20 > 1) == 0


def test_trees_learn_from_every_candidate(spark, monkeypatch):
    write, kept = pii.materialize, {}
    monkeypatch.setattr(pii, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    pii.fit_detector(messages(spark, personal(400)), 20)
    weights = {r["kind"]: r["w"] for r in kept["pii-training"].filter("label = 1").groupBy("kind").agg(F.sum("weight").alias("w")).collect()}
    assert all(weights[k] == pytest.approx(2 * 20) for k in (0, 1, 3))  # as found and rewritten; none is left out


def test_bounds_come_from_every_held_text(spark, monkeypatch):
    from restomart.llm import language as L

    model, seen = L.LanguageModel(["x", "y"], np.zeros((L.BUCKETS + 1, 3), np.float32), np.zeros(2), 1.0), []
    outermost = L._outermost
    monkeypatch.setattr(L, "_outermost", lambda counted, allowed: seen.append(sum(n for _, n in counted)) or outermost(counted, allowed))
    texts = spark.range(7000).select(F.concat(F.lit("ab"), "id").alias("content"), F.lit("x").alias("language"))
    assert set(L.clean_bounds(model, texts)) == {2, 4} and max(seen) == 7000


def test_trees_need_both_sorts(spark):
    assert pii.fit_detector(messages(spark, AWKWARD)) is None
    assert pii.fit_detector(messages(spark, [])) is None


def test_redaction_keeps_rows_and_columns(spark):
    rows_in = messages(spark, AWKWARD + PERSONAL)
    done = pii.redact(rows_in, None)
    assert done.columns == rows_in.columns and done.count() == rows_in.count()
    text = {r["id"]: r["content"] for r in done.collect()}
    assert text[1] is None and text[4] == "a" and text[34] == "🙂 é [email] [phone]"
    assert text[30] == "Mail [email], or [email][email]; no: a@b, @c.d"


def spoken(n):
    letters = {"en": "the of and to in that is", "de": "der die und nicht ein ist auf", "fr": "le la les des est que une"}
    for i in range(n):
        for name, vocabulary in letters.items():
            rng = random.Random(f"{i}{name}")
            yield name, " ".join(rng.choice(vocabulary.split()) + rng.choice(["", "", "n", "s"]) for _ in range(30))


def test_language_of_held_out_texts_and_awkward_rows(spark):
    examples = spark.createDataFrame([(t, n) for n, t in spoken(40)] + [(None, "en"), ("der die", None)],
                                     "content string, language string")
    test = list(spoken(60))[120:]
    contents = list(enumerate([t for _, t in test], 100)) + AWKWARD + [(11, "12 34 !!")]
    found = identify_language(messages(spark, contents), examples)
    got = {r["id"]: r for r in found.collect()}
    right = [got[i]["language"] == n for i, (n, _) in enumerate(test, 100)]
    assert np.mean(right) > 0.95 and found.count() == len(contents)
    assert all(got[i]["language"] == "und" and got[i]["score"] == 1 for i in (1, 2, 3, 9, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[8]["language"] != "und"


def test_language_without_examples(spark):
    none = spark.createDataFrame([], "content string, language string")
    found = identify_language(messages(spark, [(1, "some words"), (2, None)]), none)
    assert rows(found, "language", "score") == [("und", 0.0), ("und", 0.0)]
    assert identify_language(messages(spark, []), none).count() == 0


def test_quality_of_held_out_texts(spark):
    junk = lambda i: " ".join(w.upper() + random.Random(f"{i}{w}").choice(["!!", "###", "&&&"]) for w in prose(i, 40).split())
    contents = [(i, prose(i, 20 + i % 30) if i % 2 else junk(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (9_999, 0), (6, 7)],
                                   "id long, quality int")
    found = {r["id"]: r for r in score_quality(messages(spark, contents), labels).collect()}
    assert np.mean([found[i]["predicted"] == i % 2 for i in range(200, 300)]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_quality_of_awkward_rows(spark):
    both = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (4, 0)], "id long, quality int")
    assert score_quality(messages(spark, AWKWARD), both).filter("score between 0 and 1").count() == len(AWKWARD)
    one = spark.createDataFrame([(5, 1)], "id long, quality int")
    assert rows(score_quality(messages(spark, [(5, LONG), (2, None)]), one), "score") == [(1.0,), (1.0,)]
    none = spark.createDataFrame([], "id long, quality int")
    assert rows(score_quality(messages(spark, [(1, None)]), none), "score") == [(0.5,)]
    assert score_quality(messages(spark, []), both).count() == 0
    assert all(np.isfinite(statistics(t)).all() for t in ("", " ", "a", LONG, "\n\n"))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", " \n", "▁", "é", "ﬁ", "①", "<s>", "</s>", "<|endoftext|>", "1", "23",
             "'s", "'", "!?", " ", "　", "\x1c", "\x85", "中", "🙂", "\r\n", "Wh", "token"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3_000)]


def test_token_counts_equal_the_library(spark, odd_texts):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    count = counter(PIECE)
    assert count.separate and [count.count(t) for t in odd_texts] == [len(x) for x in plain.encode(odd_texts)]
    words = whole_tokens(plain)
    assert len(words) > 10_000 and all(len(plain.encode(w)) == 1 for w in list(words)[::97])
    found = message_tokens(messages(spark, AWKWARD), PIECE, limit=4096)
    assert rows(found, "id", "n_bytes", "n_tokens", "over_limit") == sorted(
        ((i, len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for i, t in AWKWARD), key=key)
    assert message_tokens(messages(spark, []), PIECE).count() == 0


def test_token_counts_of_json_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE)
    found = message_tokens(messages(spark, AWKWARD), BYTE)
    assert rows(found, "id", "n_tokens") == sorted(
        ((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD), key=key)


def test_ids_equal_the_library(odd_texts):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(BYTE), byte_tokenizer(BYTE)
    for text in odd_texts + [LONG]:
        assert own.ids(text) == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE)
    contents = AWKWARD + [(100 + i, prose(i, 1 + 17 * i % 230)) for i in range(60)]
    packed = pack_messages(messages(spark, contents), BYTE, capacity=256).collect()
    want = []
    for i, text in contents:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=key) == sorted(want, key=key)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 256
    total = sum(r["length"] for r in packed)
    assert len(sequences) <= -(-total // 256) * 1.05 + 1
    assert pack_messages(messages(spark, []), BYTE).count() == 0


def best_packing(items, capacity):
    """Fewest bins by trying everything."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i] and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] - items[i]] + bins[j + 1:])
        place(i + 1, bins + [capacity - items[i]])

    place(0, [])
    return best


def test_bin_completion_against_all_packings():
    rng = random.Random(2)
    for _ in range(120):
        capacity = rng.choice([10, 20, 31])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        counts = {k: items.count(k) for k in items}
        plan = complete_bins(counts, capacity)
        used = {}
        for lengths, copies in plan:
            assert sum(lengths) <= capacity
            for k in lengths:
                used[k] = used.get(k, 0) + copies
        assert used == counts
        bins, best = sum(c for _, c in plan), best_packing(items, capacity)
        assert lower_bound(counts, capacity) <= best <= bins <= best + 1
    assert complete_bins({}, 10) == []


def test_bin_completion_of_many_items_is_a_small_plan():
    plan = complete_bins({k: 1_000_000 + k for k in range(1, 1025)}, 1024)
    assert len(plan) < 10_000
    total = sum(k * (1_000_000 + k) for k in range(1, 1025))
    assert sum(c for _, c in plan) <= 1.002 * total / 1024


def test_hash_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
