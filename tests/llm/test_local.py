"""Parts that need no Spark, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import bpe, chat, common, exact_dedup, quality, substring_dedup, toxicity

ALPHABET = [*"aabcdeéèñß 'stnΣσς<|>\t\n\x1c\x85　İ1٣中🎉́!?", "'s", "'re", "<|endoftext|>", "the", "haha"]
said = st.lists(st.sampled_from([*"ab\\<>|/[]\n", "<|end|>", "<|turn|>", "</s>", "[INST]", "[/INST]"]), max_size=12).map("".join)
texts = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=4))
def test_bpe_equals_the_library(batch):
    from tokenizers import Tokenizer

    own, lib = bpe.codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    got = own.encode(batch)
    want = [e.ids for e in lib.encode_batch(batch, add_special_tokens=False)]
    assert got == want
    assert [own.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_compatible_pairs_are_those_that_merging_keeps(codec):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 12))) for _ in range(2000)] + ["a" * 40, "ha" * 30]
    assert codec.encode_words(words) == [codec.merge(w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>", "a\nb", "\\n"]), said), max_size=5))
def test_chat_reads_back(turns):
    formatted, mask = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(chat.OPEN) == formatted.count(chat.CLOSE) == len(turns)


def test_chat_fold():
    fold = chat.Fold()
    for e in [(1, "message", None, "user", "hi"), (2, "message", None, "assistant", "he"), (3, "delta", 2, None, "llo"), (4, "edit", 1, None, "HI"), (5, "message", None, "user", "more"), (6, "regenerate", 2, None, "bye"), (7, "delta", None, None, "!"), (8, "delta", 99, None, "lost")]:
        fold.apply(*e)
    assert fold.turns() == [("user", "HI"), ("assistant", "bye!")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", " ", "\n", "\x0b", "é"]), max_size=30).map("".join), max_size=6))
def test_word_hashes(batch):
    raw = [t.encode() for t in batch]
    known: dict = {}
    for text, h in zip(raw, common.doc_word_hashes(raw), strict=True):
        assert (h == common.word_hashes(text)).all() and len(h) == len(text.split())
        for w, k in zip(text.split(), h.tolist(), strict=True):
            assert known.setdefault(w, k) == k
    assert len(set(known.values())) == len(known)


def test_anchors_are_window_minima():
    h = common.word_hashes(b" ".join(random.Random(1).choices([b"a", b"b", b"c", b"d"], k=300)))
    m, g = substring_dedup.window_anchors(h)
    assert len(m) == len(h) - substring_dedup.WINDOW + 1
    assert all(m[i] == g[i : i + 28].min() for i in range(len(m)))
    assert not len(substring_dedup.window_anchors(h[:34])[0])


def test_cuckoo_index_against_a_set():
    rng, index, live = np.random.default_rng(5), exact_dedup.CuckooIndex(4), set()
    pool = rng.integers(0, 2**63, (6000, 4), dtype=np.uint64)
    for _ in range(12):
        add = np.unique(pool[rng.integers(0, 6000, 900)], axis=0)
        fresh = add[index.find(add) < 0]
        index.insert(fresh)
        assert {tuple(k) for k in fresh.tolist()}.isdisjoint(live)
        live |= {tuple(k) for k in fresh.tolist()}
        gone = np.unique(pool[rng.integers(0, 6000, 300)], axis=0)
        assert index.delete(gone).tolist() == [tuple(k) in live for k in gone.tolist()]
        live -= {tuple(k) for k in gone.tolist()}
        assert (index.find(pool) >= 0).tolist() == [tuple(k) in live for k in pool.tolist()]


def test_folding_and_matching():
    assert toxicity.fold("Ѕtupid 1d10t!! $cum 2024 café") == " stupid idiot scum cafe "
    automaton = toxicity.matcher({" idio": 3.0, " loser ": 2.0})
    assert [w for _, _, w in toxicity.hits(automaton, " idiot a loser losers loser ")] == [3.0, 2.0, 2.0]
    assert toxicity.live_hits(automaton, {" sore loser "}, " a sore loser ") == []


def naive_hits(lexicon, folded):
    """Leftmost, longest, not overlapping, by looking at every place."""
    out, at = [], 0
    while at < len(folded):
        found = [k for k in lexicon if folded.startswith(k, at)]
        if found:
            best = max(found, key=len)
            out.append((at, at + len(best), lexicon[best]))
            at += len(best) - 1
        else:
            at += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "abc", "b", "ba"]), max_size=12), st.sets(st.sampled_from([" a", " ab", " ab ", " b ", " abc", " ba"]), min_size=1))
def test_matching_equals_brute_force(words, entries):
    folded = " " + " ".join(words) + " "
    lexicon = {k: float(n) for n, k in enumerate(sorted(entries), 1)}
    assert toxicity.hits(toxicity.matcher(lexicon), folded) == naive_hits(lexicon, folded)


def bags(rng, n=4):
    counts = rng.integers(1, 5, n)
    return rng.normal(size=(counts.sum(), quality.N_FEATURES)), counts, rng.integers(0, 2, n).astype(float)


def test_attention_equals_brute_force():
    rng = np.random.default_rng(3)
    x, counts, _ = bags(rng)
    model = quality.GatedAttention()
    p, want, at = model.p, [], 0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for n in counts:
        z = np.tanh(np.clip(x[at : at + n], -6, 6) @ p["E"] + p["e"])
        weight = [float(np.exp((np.tanh(k @ p["V"]) * sigmoid(k @ p["U"])) @ p["w"])[0]) for k in z]
        mean = sum(w * k for w, k in zip(weight, z, strict=True)) / sum(weight)
        want.append(float(sigmoid(mean @ p["o"] + p["b"])[0]))
        at += n
    assert np.allclose(model.predict(x, counts), want, atol=1e-5)


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    x, counts, y = bags(rng)
    model = quality.GatedAttention()
    starts, bag = np.r_[0, np.cumsum(counts)[:-1]], np.repeat(np.arange(len(counts)), counts)

    def loss():
        p = model._forward(x, starts, bag)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    got = model._gradient(x, starts, bag, y)
    for name, v in model.p.items():
        for k in {tuple(int(rng.integers(0, n)) for n in v.shape) for _ in range(4)}:
            old = v[k]
            v[k] = old + 1e-5
            up = loss()
            v[k] = old - 1e-5
            down = loss()
            v[k] = old
            assert abs((up - down) / 2e-5 - got[name].reshape(v.shape)[k]) < 1e-6, name


def test_fit_takes_every_passage_of_long_documents():
    rng = np.random.default_rng(5)
    counts = np.array([3000, 1, 2, 1500, 4, 1] * 4)
    y = np.arange(len(counts)) % 2.0
    x = rng.normal(size=(counts.sum(), quality.N_FEATURES)).astype(np.float16)
    x[:, 0] += np.repeat(3 * y, counts)
    model = quality.GatedAttention()
    model.fit(x, counts, y, epochs=60)
    assert np.allclose(model.mean, x.astype(np.float64).mean(axis=0))
    assert ((model.predict(x, counts) > 0.5) == (y > 0)).all()


def test_remembered_words_of_two_generations(monkeypatch, codec):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    own = bpe.Codec(bpe.default_path())
    rng = random.Random(8)
    said = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(30)) for _ in range(40)]
    assert [own.encode([t])[0] for t in said] == codec.encode(said)
    assert len(own.chunks.new) < 60


def test_other_tokenizer_files_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Codec(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_greedy_factors():
    w = substring_dedup.WINDOW
    runs = [{"start": 5, "n": 10, "s_one": 1, "s_two": 2, "s_start": 100}, {"start": 15, "n": 4, "s_one": 1, "s_two": 2, "s_start": 110}, {"start": 30, "n": 20, "s_one": 3, "s_two": 4, "s_start": 0}]
    found, gone = substring_dedup.factors(100, runs)
    # the second run goes on where the first one ends; all windows of the third start inside that factor
    assert found == [(5, 14 + w - 1, (1, 2), 100)]
    assert np.flatnonzero(gone).tolist() == list(range(5, 50 + w - 1))
    later = substring_dedup.factors(200, [*runs[:2], {"start": 50, "n": 20, "s_one": 3, "s_two": 4, "s_start": 7}])[0]
    assert later == [(5, 14 + w - 1, (1, 2), 100), (53, 17 + w - 1, (3, 4), 10)]
    assert substring_dedup.factors(3, [])[0] == [] and not substring_dedup.factors(0, [])[1].size


def test_long_texts_are_hashed_like_short_ones(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcé", k=rng.randint(1, 30))) for _ in range(3000)).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "PIECE", 100)
    assert (common.word_hashes(text) == whole).all()
    assert (next(iter(common.doc_word_hashes([text]))) == whole).all()


def test_postings_are_shuffled_as_one_hash_of_a_shingle_and_one_of_a_group(monkeypatch):
    import types

    from claimloom.llm import jaccard_join as j

    monkeypatch.setattr(j, "BUNCH", 50)
    draw = np.random.default_rng(4)
    rank = np.zeros(j.SLOTS, dtype=np.uint8)
    pool = draw.integers(0, 2**63, 60, dtype=np.uint64)
    often = pool[:5]
    rank[j._slots(often)] = int(4 * np.log2(j.LIST)) + 8  # dealt to 5 parts
    prefixes = [np.unique(draw.choice(pool, 6)) for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array([9] * 80, pa.int32()), pa.array([p.tobytes() for p in prefixes])], names=["group", "n", "prefix"])
    rows = pa.Table.from_batches(j._postings(types.SimpleNamespace(value=rank))(iter([batch, batch])))
    assert sum(f.type.bit_width for f in rows.schema) <= 8 * (8 + 8 + 4 + 4 + 4)
    parts = set(zip(rows["shingle"].to_pylist(), rows["part"].to_pylist(), strict=True))
    assert all((p > 0) == (np.uint64(s) in often) for s, p in parts) and len({p for _, p in parts}) > 3
    dealt = rows.sort_by([("shingle", "ascending"), ("part", "ascending")]).to_batches(17)
    got = [tuple(r.values()) for b in j._shared(iter(dealt)) for r in b.to_pylist()]
    held = {}
    for g, p in enumerate(prefixes):
        for at, s in enumerate(p.tolist()):
            held.setdefault(s, []).append((s, g, 9, at))
    assert sorted(got) == sorted(x for s, xs in held.items() if len(xs) > 1 or np.uint64(s) in often for x in xs)
