"""The ten operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import bpe_codec, common, decontamination, fingerprints, html_extraction, language_id, ngram_jaccard, quality, stages, suffix_dedup, token_counts, toxicity
from loomstone.llm.queries import QUERIES
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts):
    return frame(spark, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)])


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


EDGE_TEXTS = [None, "", " \n\t ", "word", "word", "one two three four", "a" * 5000, "é" * 300, "\x00 \x01 b", "😀 " * 50, "the cat " * 3000]


# 1


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(1)
    texts = list(EDGE_TEXTS)
    for _ in range(6):
        base = words(rng, rng.choice([6, 40, 200]))
        texts += [base, base.upper()] + [edited(rng, base, rng.choice([0.01, 0.02, 0.04])) for _ in range(12)]
        texts += [base + " " + words(rng, k) for k in (3, 20)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) < len(texts)


def test_jaccard_hot_tiles_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = words(rng, 60)
    texts = [edited(rng, base, 0.02) for _ in range(60)] + [words(rng, 50) for _ in range(20)]
    want = brute_components(list(enumerate(texts)))
    monkeypatch.setattr(ngram_jaccard, "TILE_ROWS", 8)
    monkeypatch.setattr(ngram_jaccard, "ENTRIES", 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == want


@pytest.mark.parametrize("shift, tag", [(60, ngram_jaccard.TAG), (ngram_jaccard.KEY_SHIFT, 7), (60, 1)])
def test_jaccard_short_keys_and_tags_that_coincide_lose_no_link(spark, monkeypatch, shift, tag):
    rng = random.Random(12)
    texts = [words(rng, rng.choice([3, 30])) for _ in range(20)]
    texts += [edited(rng, t, 0.02) for t in texts] + [t + " more" for t in texts]
    monkeypatch.setattr(ngram_jaccard, "KEY_SHIFT", shift)
    monkeypatch.setattr(ngram_jaccard, "TAG", tag)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_jaccard_pairs_packed_and_unpacked():
    rng = np.random.default_rng(13)
    for key in (np.zeros(3, np.uint64), np.sort(rng.integers(0, 2**44, 5000).astype(np.uint64)), np.array([5, 2**44 - 1], np.uint64), np.array([2**64 - 1], np.uint64)):
        tag = rng.integers(0, 2**40, len(key)).astype(np.uint64)
        again = ngram_jaccard.unpacked(ngram_jaccard.packed(key, tag))
        assert np.array_equal(again[0], key) and np.array_equal(again[1], tag)


def test_jaccard_pairs_take_little_of_the_shared_folder(spark, monkeypatch):
    """All tables kept at a time, signatures included, stay below 22 bytes for each shingle of the prefixes."""
    rng, kept, keep, drop = random.Random(14), {}, common.Scratch.keep, common.Scratch.drop
    texts, most = [words(rng, 1000, 10**6) for _ in range(150)], 0

    def sized(self, df, name):
        nonlocal most
        out = keep(self, df, name)
        path = out._scratch_path.removeprefix("file:")
        kept[path] = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
        most = max(most, sum(kept.values()))
        return out

    def dropped(self, df):
        kept.pop(df._scratch_path.removeprefix("file:"), None)
        drop(self, df)

    monkeypatch.setattr(common.Scratch, "keep", sized)
    monkeypatch.setattr(common.Scratch, "drop", dropped)
    assert ngram_jaccard.jaccard_components(docs_of(spark, texts)).count() == len(texts)
    assert most < 22 * sum(ngram_jaccard.prefix_size(len(t.split()) - 4) for t in texts)


def test_jaccard_nulls_repeats_and_extra_columns(spark):
    rng = random.Random(3)
    text, other = words(rng, 30), words(rng, 30)
    rows = [(None, text, 1, "k"), (4, text, 1, "k"), (4, text, 2, "k"), (9, text, 3, None), (4, other, 4, "k"), (2, other, 5, "k"), (7, "", 0, "k"), (7, None, 0, "k"), (9, words(rng, 40), 1, "k")]
    df = frame(spark, rows, "doc_id long, text string, n int, key string").withColumns({"node": F.lit(1), "th": F.lit("x"), "component": F.lit(2)})
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_jaccard.jaccard_components(df).collect())
    assert got == {(None, None): 1, (4, 4): 2, (9, 4): 1, (4, 2): 1, (2, 2): 1, (7, 7): 2, (9, 9): 1}
    assert ngram_jaccard.jaccard_components(frame(spark, [])).count() == 0
    kept = stages.one_of_each_group(df)
    assert kept.columns == df.columns
    # Of the texts of one doc_id that aren't linked none goes.
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, text), (4, text), (2, other), (7, ""), (7, None), (9, rows[-1][1])])


def test_jaccard_words_that_a_weak_hash_confuses(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([a, "x", "y", "z", "v", "w"])), (2, " ".join([b, "x", "y", "z", "v", "w"]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_jaccard_links_at_the_threshold_are_never_lost(spark):
    """Sets whose overlap is 80 of 100, the shingles that differ chosen from the smallest in the order of the prefix."""
    rng, rows, want = random.Random(5), [], {}
    for k in range(120):
        n = rng.choice([10, 50, 100])
        base = [f"d{k}w{i}" for i in range(n)]
        # Cutting words off the end loses as many shingles: n - 4 and n - 4 - cut, at the threshold or just below it.
        cut = (n - 4) // 5 + (k % 2)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - cut]))]
        want[2 * k + 1] = 2 * k if 100 * (n - 4 - cut) >= 80 * (n - 4) else 2 * k + 1
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and len(set(want.values())) > 120 / 2


def test_jaccard_prefixes_meet_wherever_the_differences_are():
    rng = np.random.default_rng(6)
    for n in (1, 2, 4, 5, 9, 10, 37, 100):
        for _ in range(50):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            heavy = np.sort(rng.choice(s, len(s) // 3, replace=False))
            order = ngram_jaccard.prefix(s, heavy, np.ones(len(heavy), np.uint8))
            gone = len(s) - math.ceil(0.8 * len(s))  # the partner lacks as many as it may, the first ones
            partner = np.setdiff1d(s, order[:gone])
            if 100 * len(partner) >= 80 * len(s):
                assert np.intersect1d(order, ngram_jaccard.prefix(partner, heavy, np.ones(len(heavy), np.uint8))).size


def test_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 60, 70, 600, 5000)]
    sets += [np.unique(np.concatenate([s, rng.integers(0, 2**63, max(1, len(s) // 9)).astype(np.uint64)])) for s in sets]
    m = ngram_jaccard.Members(np.array([len(s) for s in sets]), [ngram_jaccard.signature(s) for s in sets])
    for x in range(len(sets)):
        passing = set(m.passing(x, np.ones(len(sets), bool)).tolist())
        for y in range(len(sets)):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                assert y in passing


# 2


def test_decontamination_tolerates_substitutions_and_spares_clean(spark):
    rng = random.Random(5)
    items = [(i, words(rng, rng.choice([5, 8, 20, 50]), 10**6)) for i in range(12)] + [(90, None), (91, "")]
    rows, want = [], {}
    for i in range(60):
        text = words(rng, 80, 10**6)
        if i % 3 == 0:
            k, item = items[i % 12]
            parts = item.split()
            if len(parts) >= 20 and i % 2:
                parts[7] = "changed"
            text = f"{text}, {' '.join(parts).upper()}! {words(rng, 20, 10**6)}"
            want[i] = [k]
        rows.append((i, text))
    # A quotation of 16 words is found, one of 8 isn't.
    rows.append((98, " ".join(items[2][1].split()[:16]) + " " + words(rng, 30, 10**6) if len(items[2][1].split()) >= 20 else ""))
    rows.append((99, words(rng, 30, 10**6) + " " + " ".join(items[3][1].split()[:8]) + " " + words(rng, 30, 10**6)))
    if len(items[2][1].split()) >= 20:
        want[98] = [2]
    if len(items[3][1].split()) == 8:
        want[99] = [3]
    rows += [(100, None), (101, ""), (102, "short")]
    got = decontamination.decontaminate(frame(spark, rows, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"]} == want
    assert len(got) == 65
    assert decontamination.decontaminate(frame(spark, rows, "doc_id long, text string"), frame(spark, [], "item_id long, text string")).where("contaminated").count() == 0


def brute_leaks(docs, items):
    """All alignments of all pairs, without seeds."""
    d = decontamination
    found = set()
    for i, doc in docs:
        for k, item in items:
            x, y = doc.split(), item.split()
            span = min(d.SPAN, len(y))
            for shift in range(-len(y), len(x)):
                lo, hi = max(0, -shift), min(len(y), len(x) - shift)
                same = [y[p] == x[p + shift] for p in range(lo, hi)]
                for p in range(hi - lo - span + 1 if span else 0):
                    far, near = (same[max(0, p - r) : p + span + r] for r in (d.REACH, d.NEAR))
                    if sum(far) >= d.SHARE * len(far) or sum(near) >= d.CLOSE * len(near):
                        found.add((i, k))
    return found


def test_decontamination_equals_alignment_without_masks(spark):
    rng = random.Random(11)
    items = [(k, words(rng, n, 10**6)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24, 30, 45])]
    docs = []
    for _ in range(500):
        parts = rng.choice(items)[1].split()
        for j in rng.sample(range(len(parts)), rng.randint(0, len(parts) // 4 + 1)):
            parts[j] = "changed"
        a, b = rng.randint(0, 30), rng.randint(0, 30)
        docs.append(" ".join(words(rng, a, 10**6).split() + parts[rng.choice([0, 0, 0, 2]) :] + words(rng, b, 10**6).split()))
    docs = list(enumerate(docs))
    got = decontamination.leaks(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and 100 < len(want) < 490


def test_decontamination_long_texts_in_blocks_with_repeats(spark, monkeypatch):
    rng = random.Random(31)
    long_item, short = words(rng, 100_000, 10**6), words(rng, 3, 10**6)
    quote = " ".join(long_item.split()[70_000:70_030])
    big = words(rng, 120_000, 10**6)
    rows = [(1, f"{big} {quote}", "a"), (2, quote, "b"), (2, "other", "c"), (None, quote, "d"), (3, f"{words(rng, 9)} {short.upper()}", None), (4, None, "e"), (5, big, "f")]
    items = [(7, long_item, 1), (8, short, 2), (8, "second text of the item", 3), (None, big, 4), (9, None, 5)]
    docs, bench = frame(spark, rows, "doc_id long, text string, seed string"), frame(spark, items, "item_id long, text string, pos int")
    want = [(None, []), (1, [7]), (2, [7]), (2, [7]), (3, [8]), (4, []), (5, [])]
    for most in (decontamination.SEEDS, 400_000):
        monkeypatch.setattr(decontamination, "SEEDS", most)
        got = [(r["doc_id"], r["item_ids"]) for r in decontamination.decontaminate(docs, bench).collect()]
        assert sorted(got, key=lambda r: r[0] or 0) == want


def test_decontamination_masks_leave_a_seed_in_every_stretch():
    for n in range(1, decontamination.SPAN + 2 * decontamination.REACH + 1):
        k = min(n, decontamination.SPAN)
        masks = [sum(1 << j + o for j in m) for m in decontamination.cover(k) for o in range(n - k + 1)]
        for gone in itertools.combinations([1 << j for j in range(n)], n - math.ceil(decontamination.SHARE * n)):
            assert any(not m & sum(gone) for m in masks)


# 3


def weight(text, scorer=None):
    s = scorer or toxicity.Scorer({})
    return sum(w for _, w in toxicity.GRAMMAR.clauses([*s.tokens(text), (toxicity.BREAK, 0.0)]))


def test_grammar_scores_clauses():
    assert weight("you are an idiot") > weight("an idiot") > weight("you are not an idiot") > 0
    assert weight("he said you idiot") < weight("you idiot")
    assert weight("he said this. you idiot") == pytest.approx(weight("you idiot"))
    assert weight("i will kill you") > weight("kill you") > 0
    # A threat word without an intent or a target is an isolated word; so is one whose target is in another clause.
    assert weight("the fire may burn paper") == weight("burn paper. you") == weight("a lovely day") == weight("") == 0
    kinds = lambda t: [k for k, _ in toxicity.GRAMMAR.clauses([*toxicity.Scorer({}).tokens(t), (toxicity.BREAK, 0.0)])]
    assert kinds("an idiot, you") == [toxicity.AIMED] and kinds("an idiot") == [toxicity.PLAIN]
    assert kinds("scum! you moron; no idiot here. i will hurt them, he said. he said i will hurt them") == [toxicity.PLAIN, toxicity.AIMED, toxicity.SOFT, toxicity.MENACE, toxicity.SOFT_MENACE]


def test_composed_grammar_equals_its_transducers_in_sequence():
    t, rng = toxicity, random.Random(21)
    parts = [f() for f in t.PARTS]
    for _ in range(3000):
        symbols = rng.choices(t.SYMBOLS, weights=[6, 2, 1, 1, 1, 2, 2, 2], k=rng.randint(0, 14))
        tokens = [(s, rng.choice([1.0, 3.0]) if s in t.HARM else 0.0) for s in symbols]
        start, want = 0, []
        for end in [k for k, s in enumerate(symbols) if s == t.BREAK] + [len(symbols)]:
            clause, start = tokens[start:end], end + 1
            weights = [w for _, w in clause]
            labels = set()
            for part in parts:  # each reads the whole clause and passes the reweighted tokens to the next
                q = 0
                for k, (s, _) in enumerate(clause):
                    q, factor = part.arcs[q, s]
                    weights[k] *= factor
                labels |= part.labels[q]
            soft = bool(labels & {"negation", "report"})
            for name, symbol, kind in (("insult", t.INSULT, t.SOFT if soft else t.AIMED if "target" in labels else t.PLAIN), ("threat", t.THREAT, t.SOFT_MENACE if soft else t.MENACE)):
                if name in labels:
                    want.append((kind, sum(w for (s, _), w in zip(clause, weights) if s == symbol)))
        got = list(t.GRAMMAR.clauses([*tokens, (t.BREAK, 0.0)]))
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([w for _, w in got], [w for _, w in want])


def test_a_beginning_gives_way_to_the_word_that_explains_it(spark):
    rng = random.Random(22)
    rows = [(i, f"{words(rng, 30)} {'foulword' if i % 2 else 'clean'} {rng.choice(['grimble', 'grimbly', 'grimbles', 'grimbled']) if i % 2 else 'x'}", i % 2) for i in range(60)]
    got = toxicity.learn_lexicon(frame(spark, rows, "doc_id long, text string, y int"))
    assert "foulword" in got and "^foulw" not in got and "^grimbl" in got


def auc(y, s):
    order = np.argsort(np.argsort(s))
    y = np.asarray(y)
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / max(1, n * (len(y) - n))


def test_toxicity_held_out(spark):
    d = DATA.replace("0.001", "0.01")
    out = QUERIES["op3_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert auc(out["toxic"], out["score"]) > 0.85 and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.5)).all()


def test_classifiers_without_labels_and_with_edges(spark):
    df = docs_of(spark, EDGE_TEXTS)
    labels = frame(spark, [], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        rows = f(df, labels).collect()
        assert len(rows) == len(EDGE_TEXTS) and all(r["score"] == 0.5 for r in rows)
    labels = frame(spark, [(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        assert all(0 <= r["score"] <= 1 for r in f(df, labels).collect())
        assert f(frame(spark, []), labels).count() == 0


# 4


def naive_kneser_ney(texts):
    """p(last | three before) over all symbols, by the recursion itself on dictionaries of tuples."""
    tables = {4: Counter()}
    for t in texts:
        s = " " * 3 + re.sub(r"[^a-zäб]+", " ", t) + " "
        s = re.sub(r" +", " ", s.strip())
        s = "   " + s
        tables[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = {}
    for k, t in tables.items():
        n1, n2 = (sum(v == x for v in t.values()) for x in (1, 2))
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        seen = [v for g, v in tables[k].items() if g[:-1] == gram[:-1]]
        if not seen:
            return p(gram[1:])
        return max(tables[k][gram] - d[k], 0) / sum(seen) + d[k] * len(seen) / sum(seen) * p(gram[1:])

    return p, sorted({g[0] for g in tables[1]})


def test_language_models_equal_a_naive_one(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choices("abäб ", weights=[5, 4, 2, 1, 3], k=60)).strip() for _ in range(8)]
    texts = [re.sub(" +", " ", t) for t in texts]
    rows = [("x", False, int(c), int(x), 1) for c, x in zip(*language_id.spell(texts)[:2])]
    grams = frame(spark, rows, language_id.GRAMS).groupBy("lang", "context", "last").agg(F.sum("n").alias("n"))
    model = language_id.fitted(grams)
    p, alphabet = naive_kneser_ney(texts)
    code = lambda c: 0 if c == " " else ord(c)
    for gram in itertools.product(" abäбz", repeat=4):
        context = (code(gram[0]) << 42) | (code(gram[1]) << 21) | code(gram[2])
        got = model.log_p(np.array([context]), np.array([code(gram[3])]))[0, 0]
        assert got == pytest.approx(math.log(p(gram)), abs=1e-4), gram
    for context in itertools.product(" ab", repeat=3):  # with the symbol for what was never seen they are distributions
        assert sum(p((*context, c)) for c in [*alphabet, "z"]) == pytest.approx(1)
    score, n, letters = model.score([texts[0], ""])
    s = "   " + texts[0]
    assert n.tolist() == [len(s) - 3, 0] and score[0, 0] == pytest.approx(-sum(math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3), abs=1e-4)


def test_language_id_knows_the_letters_of_all_planes_and_ties(spark):
    deseret = "\U00010428\U00010429 \U0001042a\U0001042b " * 9
    rows = [(i, deseret[i % 3 :], "ds", "s", 0) for i in range(30)] + [(100 + i, "の日本語 テキスト" * (1 + i % 4), "ja", "s", 0) for i in range(30)] + [(200 + i, "नमस्ते दुनिया " * (1 + i % 4), "hi", "s", 0) for i in range(30)]
    rows += [(300, deseret, None, None, None), (None, "日本語", "ja", None, None), (301, "\U000323b5\U0003fffe 123", "xx", "s", 0), (302, "の日本", None, "s", 1), (302, "の日本", None, "s", 1)]
    df = frame(spark, rows).withColumns({"held": F.lit("x"), "context": F.lit(1), "share": F.lit(None).cast("int")})
    got = language_id.language_id(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[300]["lang_pred"] == "ds" and by[302]["lang_pred"] == "ja" and by[None]["lang_pred"] == "ja"
    assert by[301]["lang_pred"] == "und" and by[301]["score"] == 0
    assert all(by[i]["lang_pred"] == lang for k, lang in ((0, "ds"), (100, "ja"), (200, "hi")) for i in range(k, k + 30))
    # Two languages learned from the same texts: the first by name.
    same = frame(spark, [(k, f"word of text {k // 2}", "ba"[k % 2], "s", 0) for k in range(60)]).withColumn("doc_id", F.lit(1).cast("long"))
    assert {r["lang_pred"] for r in language_id.language_id(same).collect()} <= {"a", "und"}
    assert language_id.language_id(frame(spark, [])).count() == 0


def test_language_id_held_out_and_edges(spark):
    d = DATA.replace("0.001", "0.01")
    docs = common.documents(spark, d)
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and not out["rejected"].any()
    extra = frame(spark, [(i, t, None, "s", 0) for i, t in enumerate(EDGE_TEXTS, 10**6)] + [(2 * 10**6, "xqzjk vwqxz kjqzx " * 60, None, "s", 0)])
    got = {r["doc_id"] - 10**6: r for r in language_id.language_id(docs.unionByName(extra)).where("doc_id >= 1000000").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert got[10**6]["rejected"]
    assert {r["lang_pred"] for r in language_id.language_id(extra).collect()} == {"und"}


def test_language_that_was_not_learned_is_rejected(spark):
    docs = common.documents(spark, DATA.replace("0.001", "0.01"))
    for gone in ("de", "en", "fr"):
        left = docs.withColumn("lang", F.when(F.col("lang") != gone, F.col("lang")))
        out = language_id.language_id(left).join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").toPandas()
        out = out[out["held_out"] & (out["size"] > 300)]
        assert out[out["lang"] == gone]["rejected"].mean() > 0.7
        assert out[out["lang"] != gone]["rejected"].mean() < 0.02


# 5


def test_token_counts_equal_greedy_pieces():
    rng = random.Random(7)
    for _ in range(200):
        first, inner = ({bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(6)} for _ in range(2))
        automaton = token_counts.Automaton(first, inner)
        for _ in range(40):
            w, at, n = bytes(rng.choices(b"abc", k=rng.randint(1, 10))), 0, 0
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in (inner if at else first)), None)
                if end is None:
                    n = 1
                    break
                at, n = end, n + 1
            assert automaton.count(w) == n


def test_token_counts_rows(spark):
    rows = token_counts.token_counts(docs_of(spark, EDGE_TEXTS)).collect()
    assert len(rows) == len(EDGE_TEXTS) and rows[0]["n_tokens"] == 0 and all(r["n_tokens"] >= r["n_words"] for r in rows)


def test_token_counts_query_equals_greedy_words(spark):
    first, inner = token_counts.pieces(token_counts.vocabulary_path())
    longest = max(map(len, first | inner))

    def greedy(word):
        w, at, n = word.encode("utf-8", "surrogatepass"), 0, 0
        while at < len(w):
            end = next((e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in (inner if at else first)), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    texts = [t for t in EDGE_TEXTS if len(t or "") < 4000] + ["Straße 12,345 naïve café — 日本語!!", *(r[0] for r in common.documents(spark, DATA).select("text").limit(40).collect())]
    for r in token_counts.token_counts(docs_of(spark, texts)).collect():
        found = token_counts._WORDS.findall(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_tokens"]) == (len(found), sum(map(greedy, found)))


# 6


def test_fingerprints_equal_brute_force(spark):
    texts = [*EDGE_TEXTS, "Ｆｕｌｌ　ｗｉｄｔｈ", "full width", "É", "é", "ΑΣ", *(f"text {i} " * 30 for i in range(30))]
    ids = random.Random(8).sample(range(-500, 10**9), len(texts))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, list(zip(ids, texts)), "doc_id long, text string")).collect()}
    form = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).lower())).strip()
    rows = sorted(((i, t or "") for i, t in zip(ids, texts)), reverse=True)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["near_edited"] == float(form(t) == form(e)) and got[i]["near_next"] == float(form(t) == form(nxt))
    by = {}
    for i, t in rows:
        by.setdefault(got[i]["fingerprint"], set()).add(form(t))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({form(t) for _, t in rows})


def test_fingerprints_ranges_one_row_and_none(spark, monkeypatch):
    assert fingerprints.fingerprints(frame(spark, [], "doc_id long, text string")).count() == 0
    r = fingerprints.fingerprints(frame(spark, [(7, "ab")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(i * 7, f"t{i}") for i in range(50)] + [(None, "n1"), (None, "n2")]
    got = fingerprints.with_next(frame(spark, rows, "id long, text string").withColumn("tie", F.xxhash64("text")), ["text"]).collect()
    follow = {r["text"]: r["next_text"] for r in got}
    assert len(got) == 52 and all(follow[f"t{i}"] == f"t{i - 1}" for i in range(1, 50)) and follow["t0"] in ("n1", "n2")


def test_fingerprints_ranges_are_even_whatever_the_ids(spark):
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("i"), F.xxhash64("id").alias("tie"))
    shapes = {
        "outlier": F.when(F.col("i") == 7, F.lit(1 << 60)).otherwise(F.col("i")),
        "nulls": F.when(F.col("i") % 3 == 0, F.lit(None)).otherwise(F.col("i")),
        "one id": F.when(F.col("i") % 3 == 0, F.lit(5)).otherwise(F.col("i")),
    }
    for name, id_ in shapes.items():
        df = rows.withColumn("id", id_.cast("long"))
        sizes = sorted(r["count"] for r in df.withColumn("r", fingerprints.ranges(df)).groupBy("r").count().collect())
        assert len(sizes) > n // fingerprints.RANGE_ROWS // 2 and sizes[-1] < 3 * sizes[len(sizes) // 2], name
        follow = {(r["id"], r["tie"]): (r["next_id"], r["next_tie"]) for r in fingerprints.with_next(df, ["id", "tie"]).collect()}
        order = sorted(follow, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        assert len(order) == n and all(follow[a] == b for a, b in zip(order, order[1:] + order[:1])), name


def test_fingerprints_repeated_ids_and_clashing_columns(spark):
    rows = [(5, "a", 1, "x"), (5, "b", 2, "x"), (5, "b", 2, "x"), (3, "c", 3, None), (None, None, 4, "y")]
    got = fingerprints.fingerprints(frame(spark, rows, "doc_id long, text string, id int, tie string")).collect()
    assert Counter(r["doc_id"] for r in got) == {5: 3, 3: 1, None: 1} and sum(r["near_next"] == 1.0 for r in got) == 1


# 7

PAGE = """<html><head><title>T</title></head><body><header><a href=/>Home</a></header><div class="cookie-banner">We use cookies</div><nav>menu</nav><div id="wrap7"><article><h1>Big &amp; title</h1><p>First <b>bold</b>
 text&nbsp;here.<p>Second &#8212; par<br>line <a href="x>y">link</a>.</p><ul><li>one<li>two</ul><div class="ad">BUY</div><form><p>form</p></form><script>if(a<b){x("</p>")}</script><!-- <p>no</p> -->
 <section class="comments"><p>Nice post, a long reader comment, longer than the article itself, on and on and on</p></section></article><aside>side</aside></div><footer>foot</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "http://h.org/a", PAGE), (2, "http://h.org/b", None), (3, None, ""), (4, "x", "plain &lt;text&gt; <b>only"), (5, "http://h.org/c", PAGE[: PAGE.index("<form>")])]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    want = "Big & title First bold text here. Second — par line link. one two"
    assert got == {1: want, 2: "", 3: "", 4: "plain <text> only", 5: want}
    assert html_extraction.extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_html_consensus_beats_a_page_of_comments(spark):
    body = "<div class='c{0}'><div class='story{0}'><p>{1}</p></div><div class='rail'><p>{2}</p></div></div>"
    rows = [(i, "http://h.org/x", body.format(i, "story words " * 20, "rail " * 3)) for i in range(9)] + [(9, "http://h.org/x", body.format(9, "short story", "rail text without end " * 40))]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short story"


def test_html_names_of_layouts_and_furniture():
    page = lambda cls, text: f"<body><div class='page-header'><p>site header</p></div><div class='{cls}'><div class='post-header'><h1>Title</h1></div><p>{text}</p></div><div class='post-comments'><p>{'comment ' * 60}</p></div></body>"
    for cls in ("content", "layout has-sidebar", "story12"):
        assert html_extraction.Page(page(cls, "the story " * 20)).extract(None) == "Title " + ("the story " * 20).strip()
    assert html_extraction.Page("<div class='sidebar-wrap'><nav>menu</nav><p>all there is</p></div>").extract(None) == "all there is"
    assert html_extraction.Page("<nav>menu only</nav>").extract(None) == ""


def extracted(html):
    return html_extraction.Page(html).extract(None)


def test_html_loses_nothing_of_an_article():
    long, short, head = "long text " * 330, "short text " * 72, "Head"
    want = f"{head} {long.strip()} {short.strip()}"
    page = "<body><nav>menu</nav>{}<footer>foot</footer></body>"
    assert extracted(page.format(f"<article><h1>{head}</h1><div>{long}</div><div>{short}</div></article>")) == want
    assert extracted(page.format(f"<div class=post><h1>{head}</h1><div class=body><div>{long}</div><div>tiny</div></div></div>")) == f"{head} {long.strip()} tiny"
    assert extracted(page.format(f"<main><p>{head}</p><blockquote>{long}</blockquote><p>{short}</p></main>")) == want
    assert extracted(page.format(f"<div class=c><p>{head}</p><blockquote><p>{long}</p></blockquote><p>{short}</p></div>")) == want
    assert extracted(page.format(f"<article data-title='a hidden gem' data-x=hidden><p>{head}</p><p>{long}</p><p>{short}</p></article>")) == want
    assert extracted(page.format(f"<article><p>{head}</p><div class='search-results-analysis'><p>{long}</p></div><div id=share-price-chart>{short}</div></article>")) == want
    for gone in ("<div hidden>x</div>", "<div class='nyt-comments-panel'>x</div>", "<p hidden=''>x</p>", "<div style='display: none'>x</div>", "<div class='related-articles'>x</div>", "<section id='cookie-notice'>x</section>"):
        assert extracted(page.format(f"<article><p>{head}</p>{gone}<p>{long}</p><p>{short}</p></article>")) == want


def test_html_constructed_pages_equal_what_they_were_made_of():
    """Pages put together from article parts and furniture, in random order and nesting, against the parts."""
    rng = random.Random(41)
    for _ in range(300):
        parts, texts = [], []
        for _ in range(rng.randint(1, 9)):
            text = " ".join(words(rng, rng.randint(3, 60)).split())
            wrap = rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>", "<p title='not hidden > here'><b>{}</b></p>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>"])
            texts.append(text)
            parts.append(wrap.format(text))
            if rng.random() < 0.4:
                junk = words(rng, rng.randint(1, 80))
                parts.append(rng.choice(["<aside>{}</aside>", "<div class='ad-slot'>{}</div>", "<form><p>{}</p></form>", "<div id=comments><p>{}</p></div>", "<script>{}</script>", "<!-- {} -->", "<nav><a href=x>{}</a></nav>"]).format(junk))
        tag = rng.choice(["article", "main"])
        html = f"<html><body><header>{words(rng, 5)}</header><div class=page><{tag}>{chr(10).join(parts)}</{tag}><div class=sidebar>{words(rng, 50)}</div></div><footer>{words(rng, 9)}</footer></body></html>"
        assert extracted(html) == " ".join(texts)


def test_html_votes_ties_hot_host_and_salted_join(spark, monkeypatch):
    page = "<body><div class='{}'><p>{}</p></div><div class='{}'><p>{}</p></div></body>"
    rows = [(1, "http://t.org/1", page.format("a", "x" * 50, "b", "y")), (2, "http://t.org/2", page.format("a", "x", "b", "y" * 50))]
    rows += [(k, f"http://hot.org/{k}", page.format("s", "story " * 9, "r", "r")) for k in range(10, 300)] + [(None, None, None), (3, "http://t.org/2", None), (3, "http://t.org/2", None)]
    df = frame(spark, [(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, path int").repartition(7)
    for most in (html_extraction.SMALL, -1):
        monkeypatch.setattr(html_extraction, "SMALL", most)
        got = html_extraction.extract_pages(df).collect()
        by = {r["page_id"]: r["text"] for r in got}
        assert len(got) == len(rows) and by[1] == "x" * 50 and by[2] == "x"  # one vote each: the first path by name
        assert all(by[k] == ("story " * 9).strip() for k in range(10, 300)) and by[None] == by[3] == ""


def test_html_that_is_broken_on_purpose():
    for html in ("<" * 100_000, '<a href="' * 20_000, "<div>" * 20_000 + "deep", "<p>x" * 20_000, "<!-- open " * 20_000, "<script>" * 1000, "<b>" * 3000 + "x" + "</b>" * 3000):
        html_extraction.Page(html).extract(None)
    assert html_extraction.Page("<div>" * 1000 + "deep" + "</div>" * 1000).extract(None) == "deep"
    assert html_extraction.Page("<p>seen</p><!-- never closed <p>hidden").extract(None) == "seen"


# All


def test_null_ids_repeats_clashing_columns_long_texts_and_no_rows(spark):
    """Every operator on rows with null ids, repeated rows, a long text and columns named like those it uses inside."""
    long = words(random.Random(61), 60_000)
    rows = [(None, "some text of a row without an id", "en"), (1, long, "en"), (1, long, "en"), (2, None, None), (3, "", "fr"), (4, "you idiot", "en")]
    clash = {k: F.lit("x") for k in ("n", "y", "x", "share", "held_out", "score", "seed", "pos", "toks", "part", "chunk", "node", "key", "band", "sig", "id", "tie", "range", "place", "wide", "canon", "did", "th", "spans", "lists", "open", "trig", "html", "host", "path", "ids", "k", "size", "own")}
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumns(clash)
    labels = frame(spark, [(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "share": F.lit(1)})
    bench = frame(spark, [(1, "some text of a row without an id"), (None, "you idiot")], "item_id long, text string").withColumns({"doc_id": F.lit(1), "n": F.lit(2)})
    pages = frame(spark, [(None, None, None), (1, "http://a/b", f"<article><p>{long}</p></article>"), (1, "http://a/b", f"<article><p>{long}</p></article>")], "page_id long, url string, html string").withColumns({k: F.lit(1) for k in ("host", "path", "text", "salt", "votes")})
    runs = {
        "jaccard": lambda d: ngram_jaccard.jaccard_components(d), "decontamination": lambda d: decontamination.decontaminate(d, bench), "toxicity": lambda d: toxicity.toxicity(d, labels),
        "language": lambda d: language_id.language_id(d), "tokens": lambda d: token_counts.token_counts(d), "fingerprints": lambda d: fingerprints.fingerprints(d),
        "quality": lambda d: quality.quality(d, labels), "bpe": lambda d: bpe_codec.bpe_codec(d), "suffix": lambda d: suffix_dedup.suffix_dedup(d),
    }
    for name, run in runs.items():
        got = run(docs).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows), name
        once = [tuple(r) for r in got if r["doc_id"] == 1]
        assert name in ("fingerprints", "suffix") or once[0] == once[1], name
        assert run(docs.where("false")).count() == 0, name
    got = html_extraction.extract_pages(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len(long), len(long)] and html_extraction.extract_pages(pages.where("false")).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


# 8


def test_quality_held_out(spark):
    d = DATA.replace("0.001", "0.01")
    out = QUERIES["op8_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert auc(out["quality"], out["score"]) > 0.97 and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(9)
    field = quality.Field(np.zeros(quality.N_OWN), np.ones(quality.N_OWN))
    field.t = rng.normal(size=(2, 2))
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    good = rng.normal(size=7)
    p, pair = field.marginals(good, text)
    for t in range(3):
        at = np.flatnonzero(text == t)
        total, mass = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            w = np.exp(sum(good[a] * v for a, v in zip(at, y)) + sum(field.t[a, b] for a, b in zip(y, y[1:])))
            total, mass = total + w, mass + w * np.array(y)
        assert np.allclose(p[at], mass / total)
    assert np.allclose(pair.sum((1, 2)), 1) and len(pair) == 4


def test_quality_reads_a_line_by_its_neighbours():
    """Plain lines are good among plain lines and bad between shouted ones: only a field with neighbours can tell."""
    rng = np.random.default_rng(51)
    x, text, y = [], [], []
    for k in range(400):
        shout = k % 2
        kinds = [1, 0, 1, 0, 1] if shout else [0, 0, 0, 0, 0]
        for kind in kinds:
            row = rng.normal(0, 0.1, quality.N_OWN)
            row[0] = kind
            x.append(row)
            text.append(k)
            y.append(0.0 if shout else 1.0)
    x, text, y = np.array(x), np.array(text), np.array(y)
    field = quality.Field(x.mean(0), np.maximum(x.std(0), 1e-6))
    field.fit(x, text, y)
    plain = x[:, 0] == 0
    right = lambda p: ((p > 0.5) == (y > 0.5))[plain].mean()
    assert right(field.marginals(field.unary(x, text), text)[0]) > 0.99
    alone = field.unary(x, text) - quality.with_neighbours(np.clip((x - field.mean) / field.scale, -5, 5), text)[:, quality.N_OWN : 3 * quality.N_OWN] @ field.w[quality.N_OWN : 3 * quality.N_OWN]
    field.t[:] = 0
    assert right(field.marginals(alone, text)[0]) < 0.8


def test_quality_learns_from_all_lines():
    rng = random.Random(12)
    texts = [("\n".join(f"A line number {i} of {words(rng, 8)}." for i in range(60)) + "\n" + "BUY!!! NOW | 777 !!!\n" * (40 * (k % 2))) for k in range(8)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array([1 - k % 2 for k in range(8)], pa.int32()), pa.array(texts)], names=["doc_id", "y", "text"])
    sizes = [len(np.frombuffer(b)) for b in next(iter(quality._lines([batch]))).column(3).to_pylist()]
    assert sizes == [60 + 40 * (k % 2) for k in range(8)]


# 9


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe_codec.vocabulary_path()
    library = Tokenizer.from_file(path)
    odd = ["ΟΔΥΣΣΕΥΣ Σ", "İstanbul ı", "a<|endoftext|>b <|startoftext|>", "é café ½ ٣ 12", "'S 'LL don'T I'd", "\x1c\x1d\x85 x", "日本語 テキスト 🙂🙂", "ab" * 200 + "!" * 100, "<|endoftext", "😀" * 70]
    texts = [*EDGE_TEXTS, *odd, *(r[0] for r in common.documents(spark, DATA).select("text").collect())]
    got = {r["doc_id"]: r for r in bpe_codec.bpe_codec(docs_of(spark, texts), with_ids=True).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False)
        back = library.decode(e.ids, skip_special_tokens=False)
        assert got[i]["ids"] == e.ids and got[i]["decoded"] == back and got[i]["n_tokens"] == len(e.ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_scan_and_heap_agree():
    with open(bpe_codec.vocabulary_path(), encoding="utf-8") as f:
        bpe = bpe_codec.Bpe(json.load(f))
    rng = random.Random(10)
    for _ in range(300):
        parts = [bpe.ids[c] for c in rng.choices("etaoinsrhl", k=rng.randint(1, 40))]
        assert bpe._scan(list(parts)) == bpe._heap(list(parts))


# 10


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts(rng):
    passages = [words(rng, rng.choice([18, 30, 80])) for _ in range(5)]
    texts = list(EDGE_TEXTS) + ["ab" * 400, "ab" * 400, "é" * 120]
    for i in range(40):
        texts.append(" ".join(rng.choice([passages[rng.randrange(5)], words(rng, rng.randrange(1, 40))]) for _ in range(4)))
    texts += texts[20:24] + [edited(rng, t, 0.03) for t in texts[24:30] if t]
    return texts


@pytest.mark.parametrize("hot", [2_000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = repeat_texts(random.Random(11))
    ids = random.Random(12).sample(range(-100, 10**6), len(texts))
    rows = list(zip(ids, texts))
    df = frame(spark, rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == brute_spans(rows)


def test_prefix_free_order_is_that_of_the_suffixes(monkeypatch):
    rng = random.Random(32)
    for every in (1, 3, 8, 64):  # every position a trigger, or almost none
        monkeypatch.setattr(suffix_dedup, "EVERY", every)
        texts = [t.encode() for t in repeat_texts(rng) if t][:40] + [b"a" * 300, b"\x00" * 250, b"\xff\x00" * 90, b"", b"x" * 99]
        text, offset, same = suffix_dedup.corpus_order(texts)
        want = sorted(texts[i][k : k + 100] for i in range(len(texts)) for k in range(len(texts[i]) - 99))
        got = [texts[i][k : k + 100] for i, k in zip(text.tolist(), offset.tolist())]
        assert got == want and same.tolist() == [False] * (len(got) > 0) + [a == b for a, b in zip(got, got[1:])]


def test_suffix_dedup_one_hot_anchor(spark, monkeypatch):
    """A passage in every document, with other text around it: its anchors are hot in tasks and in shards."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "PART", 60)
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 50)
    rng = random.Random(33)
    passage = words(rng, 30)
    rows = [(i, f"{words(rng, 9)} {passage[: rng.choice([120, 130, 999])]} {words(rng, 9)}") for i in range(150)] + [(200 + i, "a" * (90 + 20 * i)) for i in range(6)]
    got = {r["doc_id"]: tuple(r[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.suffix_dedup(frame(spark, rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_spans(rows)


def test_suffix_dedup_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 600)
    texts = repeat_texts(random.Random(13))
    rows = list(enumerate(texts))
    batches = suffix_dedup.pieces(np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])]))
    assert all(end - start <= 700 for _, _, start, end in batches)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in brute_spans(rows).items()}


def test_suffix_dedup_repeated_ids_and_empty(spark):
    text = words(random.Random(14), 60)
    rows = [(None, text), (3, text), (3, text), (3, words(random.Random(15), 60))]
    got = suffix_dedup.suffix_dedup(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (3, 0), (3, len(text)), (3, len(text))]
    assert suffix_dedup.suffix_dedup(frame(spark, [], "doc_id long, text string")).count() == 0


def test_hard_components(spark):
    n = 300
    rng = random.Random(16)
    chain = [(i, i + 1) for i in range(n)] + [(rng.randrange(n + 1, n + 50), rng.randrange(n + 1, n + 50)) for _ in range(40)]
    scratch = common.Scratch(spark)
    got = {r["node"]: r["comp"] for r in common.components(scratch, frame(spark, chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[i] <= i for i in got)
