"""Operators on small tables with nulls, empty texts, ties and clashing names."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import bpe, chat, exact_dedup, jaccard_join, mixing, quality, rules, substring_dedup, token_scan, toxicity
from claimloom.llm.common import crc_mod
from claimloom.llm.components import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    shared, base = say(60), say(120)
    near = base.split()
    near[7] = "other"
    texts = [say(80), base, base, " ".join(near), say(40) + " " + shared + "\n" + say(30), shared + " " + say(50), "", None, "one two", "ONE two", " \n\t ", "x " * 90, say(3000), base.upper()]
    out = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 0.5, "clash") for k, t in enumerate(texts)]
    return [*out, out[0], (None, "one two", "en", "s1", 7, 0.5, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture
def patched(monkeypatch):
    """Sets constants of a module, in Spark's workers as well."""
    from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value

    done = []

    def put(module, **values):
        register_pickle_by_value(module)
        done.append(module)
        for k, v in values.items():
            monkeypatch.setattr(module, k, v)

    yield put
    for module in done:
        unregister_pickle_by_value(module)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def test_substring_dedup(docs, empty):
    all_words = [WORD.findall(r[1] or "") for r in rows()]
    count = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows(), all_words, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0], len(w), " ".join(x for j, x in enumerate(w) if j not in gone)))
    parsed = substring_dedup.parse(docs).collect()
    got = [(r["doc_id"], r["n_words"], r["kept"]) for r in parsed]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert substring_dedup.parse(empty).count() == 0
    # every document is its factors' words and literals
    text_of = {(r[0], len(WORD.findall(r[1] or ""))): WORD.findall(r[1] or "") for r in rows()}
    words = {r["uid"]: text_of[r["doc_id"], r["n_words"]] for r in parsed}
    assert any(r["factors"] for r in parsed)
    for r in parsed:
        own, at, back = words[r["uid"]], 0, []
        for f in r["factors"]:
            assert f["start"] >= at and f["n_words"] >= 35
            back += own[at : f["start"]] + words[f["source"]][f["source_start"] : f["source_start"] + f["n_words"]]
            at = f["start"] + f["n_words"]
        assert back + own[at:] == own


def test_substring_dedup_in_small_folds(spark, patched):
    """Blocks that are split, folds of few windows, and one text of more than 2 MB."""
    patched(substring_dedup, FOLDED=50, SPLIT=2)
    rng = random.Random(7)
    say = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]
    shared = say(70)
    texts = [say(rng.randint(5, 40)) + shared[: rng.randint(30, 70)] + say(rng.randint(0, 40)) for _ in range(20)]
    texts += [say(500_000) + shared, shared, shared]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    count = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    for r in substring_dedup.parse(docs).select("doc_id", "kept").collect():
        w = texts[r["doc_id"]]
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone), r["doc_id"]


def test_jaccard_join(docs, empty):
    sets = []
    for r in rows():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [r[0] for r in rows()]
    root = {k: k for k in range(len(ids))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    want = []
    for k, i in enumerate(ids):
        group = [ids[j] for j in range(len(ids)) if find(j) == find(k) and ids[j] is not None]
        want.append((i, len(sets[k]), None if i is None else min(group)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_classes(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert jaccard_join.link_classes(empty).count() == 0
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns and 2 not in {r["doc_id"] for r in left.collect()}


def by_brute_force(sets):
    """Each index's smallest linked one."""
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def test_jaccard_join_with_crowded_counters_and_a_shingle_in_most_documents(spark, patched):
    patched(jaccard_join, SLOT_BITS=6, SLOTS=64, PART=16, SALT=3, LIST=8, BUNCH=40)
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    common = say(6)
    texts = [common + say(3) for _ in range(40)] + [say(60) for _ in range(10)]
    for base in list(texts):
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = "changed"
            texts.append(other)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == by_brute_force(sets)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 201 + k) for k in range(20)]
    root = {x: x for ab in links for x in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in links)}


def test_exact_dedup(docs, empty):
    got = exact_dedup.copy_groups(docs).collect()
    assert len(got) == len(rows())
    texts = Counter(r[1] or "" for r in rows())
    shas = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert all(r["group_size"] == texts[shas[r["text_sha256"]]] for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(shas, 1))
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2)} == {2}
    assert exact_dedup.copy_groups(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(texts)


CLASHING = ["_digest", "_keep", "_turn", "_id", "_source", "_copies", "_copy", "_mark", "_score", "score"]


def test_columns_of_any_name_come_back_unchanged(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL")
    for k, x in enumerate(CLASHING):
        odd = odd.withColumn(x, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    for stage in (exact_dedup.drop_copies, mixing.repeat_documents, jaccard_join.drop_near_copies, lambda d: quality.drop_poor(d, labels, F.lit(False), -1.0)):
        out = stage(odd)
        assert out.columns == odd.columns
        got = out.collect()
        assert got and all(r[x] == f"{k}-{r['doc_id']}" for r in got for k, x in enumerate(CLASHING))


def test_a_hot_text_and_repeated_rows(spark, patched):
    patched(exact_dedup, HOT=4, SHARD=3, FOLDED=5)
    many = [(k % 50, "hot") for k in range(200)] + [(k, f"t{k % 30}") for k in range(60)] + [(None, "hot"), (None, "lone"), (None, "lone")]
    got = exact_dedup.copy_groups(spark.createDataFrame(many, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(many)
    for text in {t for _, t in many}:
        own = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        ids = [k for k, t in many if t == text]
        top = max((k for k in ids if k is not None), default=None)
        assert len(own) == len(ids) and {(r["keep_id"], r["group_size"]) for r in own} == {(top, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [top]


def test_live_digests(spark):
    key32 = lambda *ks: spark.createDataFrame([(hashlib.sha256(bytes([k])).digest(),) for k in ks], "digest binary")
    got = exact_dedup.update_index(key32(1, 2), key32(2, 3, 3), key32(1, 9))
    assert {bytes(r[0]) for r in got.collect()} == {bytes(r[0]) for r in key32(2, 3).collect()}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert len(got) == len(rows())
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(sizes.values())) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_bpe(docs, empty):
    encoded = bpe.encode(docs)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    for r in bpe.digests(docs).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids[r["doc_id"]])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back[r["doc_id"]].encode()).hexdigest()
    assert ids[6] == ids[7] == [] and bpe.digests(empty).count() == 0


def test_rules(docs, empty):
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for i, t, *_ in rows():
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        again = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
        assert (got[i]["n_symbols"], got[i]["n_dup_lines"]) == (sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert rules.judge(empty).count() == 0


def test_token_scan(docs, empty):
    import public_tokenizers
    import tiktoken

    with open(token_scan.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(str((r[0], len(enc.encode_ordinary(r[1] or "")))) for r in rows())
    for block in (1, 100, 1 << 14):  # documents of no, one and many blocks
        assert sorted(str(tuple(r)) for r in token_scan.token_counts(docs, block=block).collect()) == want, block
    assert token_scan.token_counts(empty).count() == 0


def test_token_files_hold_ids_and_separators_only(spark, tmp_path):
    docs = spark.createDataFrame([(5, "one two"), (6, ""), (7, None), (8, "three")], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/flat"
    written = token_scan.write_flat(docs, folder).collect()
    enc = token_scan.encoding(token_scan.default_path())
    flat = [k for t in ("one two", "", "", "three") for k in [*enc.encode_ordinary(t), token_scan.END]]
    (file,) = (tmp_path / "flat").glob("*.bin")
    assert np.frombuffer(file.read_bytes(), dtype="<u2").tolist() == flat
    assert [(r["first"], r["ids"], r["n_bytes"]) for r in written] == [(0, [5, 6, 7, 8], None), (4, [], 2 * len(flat))]


def test_classifiers(spark, docs, empty):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choices("aeinrst", k=rng.randint(2, 8))) for _ in range(60)) + "."
    texts = [good() if k % 3 else " | ".join(["BUY!!"] * 40) for k in range(150)]
    texts = [t + (" you idiot" if k % 4 == 0 else "") for k, t in enumerate(texts)]
    many = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(150)] + [(999, None, None)], "doc_id long, quality int, toxic int")
    held = crc_mod("doc_id", 5) == 0
    model = quality.fit(many, labels, held)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in quality.score(many, model).collect())
    lexicon = toxicity.fit(many, labels, held)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in toxicity.score(many, lexicon).collect())
    assert toxicity.score(docs, lexicon).count() == len(rows())
    assert quality.score(empty, model).count() == toxicity.score(empty, lexicon).count() == 0
    none = labels.filter("doc_id = 999")
    assert {r["score"] for r in toxicity.score(many, toxicity.fit(many, none, held)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(many, quality.fit(many, none, held)).collect()} == {0.5}


def auc(y, p):
    order = np.argsort(p)
    rank = np.empty(len(p))
    for v in np.unique(p):
        rank[p == v] = np.flatnonzero(p[order] == v).mean() + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "label", "floor"), [(quality.op5_quality, "quality", 0.95), (toxicity.op8_toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, query, label, floor):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(f"{label} IS NOT NULL")
    got = query(spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(got[label].to_numpy(), got["score"].to_numpy()) >= floor


def test_conflicting_labels_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = {tuple(r) for r in toxicity.labelled(docs, labels, "toxic", F.lit(False), 10).collect()}
    assert got == {(1, "a", 1), (2, "", 0)}


def test_chat_log_ends_in_its_turns(spark):
    shape = "conv_id long, turn long, role string, text string"
    texts = [None, "", "x", "two words", "é\U0001f600e\u0301 <|end|>\\", "[INST] a\nb"]
    turns = [(c, t, ("user", "assistant", None)[(c + t) % 3], texts[(c * 5 + t) % 6]) for c in range(9) for t in range(c)]
    turns += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (3, None, "user", "no turn"), (None, 1, "user", "no id"), (None, 1, None, None)]
    turns = spark.createDataFrame(turns, shape).repartition(5)
    log = chat.as_log(turns)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) >= 8
    want, got = ({r["conv_id"]: r for r in chat.digest(chat.reconstruct(x)).collect()} for x in (chat.as_events(turns), log))
    assert got == want and len(got) == 9
    assert chat.as_log(spark.createDataFrame([], shape)).count() == 0


def test_chat_events(spark):
    shape = "conv_id long, seq long, kind string, ref long, role string, text string, formatted string"
    log = [
        (1, 1, "message", None, "user", "hi", "x"), (1, 2, "message", None, "assistant", "he", "x"), (1, 3, "delta", 2, None, "llo", "x"), (1, 4, "edit", 1, None, "HI", "x"),
        (1, 5, "message", None, "user", "more", "x"), (1, 6, "regenerate", 2, None, "bye", "x"), (1, 7, "delta", None, None, "!", "x"), (1, 8, "delta", 99, None, "lost", "x"),
        (2, None, "message", None, None, None, "x"), (2, 1, "message", None, "a\nb", "</s>", "x"), (2, 1, "message", None, "a\nb", "</s>", "x"),
        (3, 1, "message", None, "user", "one", "x"), (3, 2, "message", None, "user", "two", "x"), (3, 3, "regenerate", 2, None, "B", "x"), (3, 3, "regenerate", 1, None, "A", "x"),
        (None, 1, "message", None, "assistant", "nobody", "x"),
    ]
    want = {1: [("user", "HI"), ("assistant", "bye!")], 2: [("", ""), ("a\nb", "</s>"), ("a\nb", "</s>")], 3: [("user", "A")], None: [("assistant", "nobody")]}
    for n in (1, 5):
        out = chat.reconstruct(spark.createDataFrame(log, shape).repartition(n))
        assert {r["conv_id"]: chat.read_back(r["formatted"]) for r in out.collect()} == want
        for r in chat.digest(out).collect():
            turns = want[r["conv_id"]]
            loss = "".join(t for role, t in turns if role == "assistant")
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert chat.digest(chat.reconstruct(spark.createDataFrame([], shape))).count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    unique = docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    unique.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
    # the middle stages by brute force
    kept = {r["doc_id"]: r["text"] or "" for r in quality.drop_poor(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), crc_mod("doc_id", 5) == 0).collect()}
    last = {t: k for k, t in sorted(kept.items())}
    ids = sorted(last.values())
    sets = []
    for k in ids:
        w = WORD.findall(kept[k].lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    stay = {ids[k] for k, root in enumerate(by_brute_force(sets)) if k == root}
    mixed = table.filter(F.col("doc_id").isin(*stay))
    want = Counter()
    for r in mixing.mix(mixed).filter("taken > 0").collect():
        want[r["doc_id"]] = -(-r["taken"] // r["size"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == want
    own = bpe.codec(bpe.default_path())
    assert all(r["ids"] == own.encode([kept[r["doc_id"]]])[0] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def prose_and_junk():
    """Prose, and from doc_id 300 on prose with every 16th word random letters."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=rng.randint(1, 4))) for _ in range(300)]
    say = lambda: rng.choices(vocab, k=rng.randint(60, 200))
    good = [" ".join(say()) for _ in range(300)]
    noise = lambda: "".join(rng.choices("bcdfghjklmnpqrstuvwxyz", k=6))
    junk = [" ".join(noise() if k % 16 == 0 else w for k, w in enumerate(say())) for _ in range(20)]
    return [(k, t, "en") for k, t in enumerate(good + junk)]


def test_rules_reject_junk_that_passes_the_base_rules(spark):
    got = rules.judge(spark.createDataFrame(prose_and_junk(), "doc_id long, text string, lang string")).collect()
    assert not any(r["base_failed"] for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 300)
    assert sum(r["kept"] for r in got if r["doc_id"] < 300) >= 290
    # the band is the quartiles of rounded log perplexities, widened; reruns agree
    lp = np.sort([round(r["log_perplexity"], 3) for r in got])
    low, high = np.percentile(lp, [25, 75])
    slack = rules.WIDE * max(high - low, 0.01)
    assert all(abs(r["band_low"] - (low - slack)) < 1e-9 and abs(r["band_high"] - (high + slack)) < 1e-9 for r in got)
    again = rules.judge(spark.createDataFrame(prose_and_junk(), "doc_id long, text string, lang string").repartition(3)).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(r["doc_id"], r["kept"]) for r in again}


def without_one(texts, depth):
    """Mean log probability of each text's grams, each scored as if it occurred once less."""
    levels = [Counter()]
    own = [[(bytes(depth - 1) + t.encode())[k : k + depth] for k in range(len(t.encode()))] for t in texts]
    for x in own:
        levels[0].update(x)
    while len(levels) < depth:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts = []
    for level in levels:
        c = [max(1, sum(n == k for n in level.values())) for k in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1])
        top = [0, 0.95, 1.9, 2.85]
        discounts.append([0.0] + [min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.05), top[k]) for k in (1, 2, 3)])

    def p(g, less):
        if not g:
            return 1 / 256
        level, d = levels[len(g) - 1], discounts[len(g) - 1]
        found = [n - (less and h == g) for h, n in level.items() if h[:-1] == g[:-1]]
        now, total = level[g] - less, sum(found)
        low = p(g[1:], less and level[g] == 1)
        cut = lambda n: d[min(n, 3)]
        return low if not total else (now - cut(now) + sum(map(cut, found)) * low) / total

    return [-sum(math.log(p(g, True)) for g in x) / len(x) if x else 0.0 for x in own]


def test_perplexity_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "The cat; the hat", "the#cat$sat", "the$cat#sat", "é and É", "", "the cat sat on the mat", "zzzzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang").repartition(3)
    got = {r["doc_id"]: r["log_perplexity"] for r in rules.measure(docs).collect()}
    want = without_one(texts, rules.DEPTH)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in range(len(texts)))


def test_symbols_and_case_have_grams_of_their_own(spark):
    def found(*texts):
        docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
        return {r["gram"]: r["n"] for r in rules.count_grams(rules.packed_grams(rules.in_chunks(docs), 5)).collect()}

    assert len(found("a # b", "A # b", "a $ b", "é", "É", "a # b")) == len({g for t in ("a # b", "A # b", "a $ b", "é", "É") for g in rules.byte_grams(t.encode()).tolist()})
    assert len(found("#####")) == 5 and len(found("#####", "$$$$$")) == 10


def test_near_copies_go_by_doc_id_and_text(spark):
    rng = random.Random(3)
    say = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(100)]
    a, b = say(), say()
    near = lambda x: " ".join([*x[:-1], "other"])
    a2, b2, a, b = near(a), near(b), " ".join(a), " ".join(b)
    run = lambda *rows: sorted((tuple(r) for r in jaccard_join.drop_near_copies(spark.createDataFrame(list(rows), "doc_id long, text string")).collect()), key=str)
    assert run((5, a), (9, a2), (5, b2), (2, b), (7, ""), (None, a)) == sorted([(5, a), (2, b), (7, ""), (None, a)], key=str)
    assert run((5, a), (5, a2), (5, b)) in (sorted([(5, a), (5, b)], key=str), sorted([(5, a2), (5, b)], key=str))
    assert len(run((5, a), (5, a.upper()), (6, a))) == 1


def twins(bits=10):
    """Two words of 2^bits letters whose sums of letters times powers modulo 2^64 agree whatever the letters count."""
    one = "a"
    for _ in range(bits):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_hash_mistakes(spark):
    one, two = twins()
    shared = [f"w{k}" for k in range(34)]
    texts = [" ".join([one, *shared]), " ".join([two, *shared]), *(" ".join(x if k % 5 == 2 else f"{k}" for k in range(60)) for x in (one, two))]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["kept"] for r in substring_dedup.parse(docs).collect()} == set(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == by_brute_force(sets)
    repeated = rules.judge(spark.createDataFrame([(0, f"{one} x y {two} x y", "en"), (1, f"{one} x y {one} x y", "en")], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in repeated.collect()} == {0: 0, 1: 6}


def test_quality_with_a_word_of_700000_letters(spark):
    rng = random.Random(21)
    good = lambda: " ".join("".join(rng.choices("aeioutn", k=rng.randint(2, 8))) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choices("#$%XQ", k=rng.randint(1, 20))) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), "en", k % 2) for k in range(80)] + [(81, "Q" * 700_000, "en", 0), (83, "x" * 700_000 + " y", "en", 0), (85, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    labels = docs.filter("q IS NOT NULL").select("doc_id", F.col("q").alias("quality"))
    held = crc_mod("doc_id", 5) == 0
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.drop("q"), quality.fit(docs, labels, held)).collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert min(got[k] for k in range(1, 80, 2)) > max(got[k] for k in range(0, 80, 2))


def test_toxicity_learns_a_word_of_50_letters(spark):
    rng = random.Random(22)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    # both words start alike, so only the whole word tells
    toxic, clean = "q" * 49 + "z", "q" * 50
    rows = [(k, f"{say()} {toxic if k % 2 else clean} {say()}", k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), crc_mod("doc_id", 3) == 1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.drop("toxic"), model).collect()}
    assert min(got[k] for k in range(1, 200, 2)) > max(got[k] for k in range(0, 200, 2))


def test_rules_with_many_shards(spark, patched):
    frame = lambda: spark.createDataFrame(prose_and_junk(), "doc_id long, text string, lang string")
    want = {r["doc_id"]: r["log_perplexity"] for r in rules.measure(frame()).collect()}
    patched(rules, SHARD=2000, CHUNK=4000)
    tables = spark.sql("SHOW TABLES").count()
    got = {r["doc_id"]: r["log_perplexity"] for r in rules.measure(frame()).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert spark.sql("SHOW TABLES").count() == tables


def test_one_shingle_in_many_different_documents_forms_few_pairs(spark, patched):
    patched(jaccard_join, SALT=50)
    rng = random.Random(21)
    rows = []
    for k in range(2000):
        n = rng.choice([rng.randint(1, 12), rng.randint(5, 900), 300])
        late = n - -(-4 * n // 5)
        # frequent shingles stand late in a prefix; some documents have it early all the same
        rows.append((7, k, n, rng.randint(0, late) if k % 20 == 0 else late, rng.choice([1, 1, k])))
    ranked = spark.createDataFrame(rows, "shingle long, group long, n int, at int, root long").repartition(3)
    met = jaccard_join._meetings(ranked, lambda df, *_: df)
    got = {tuple(sorted((r["u_group"], r["v_group"]))) for r in met.filter("u_root <> v_root").filter(jaccard_join._may_link("u", "v")).collect()}
    want = set()
    for a in range(2000):
        for b in range(a):
            (_, x, n, i, r), (_, y, m, j, s) = rows[a], rows[b]
            if r != s and 180 * min(n - i, m - j) >= 80 * (n + m):
                want.add((y, x))
    assert want and got == want
    assert met.count() < 2000 * 2000 / 20
