"""Exact copies, spelling variants and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hourspark.llm import exact_copies, search, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, id string, term string, shard string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "v") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["pre", "tion", "ando", "mer", "ést", "ÀB", "kel", "vor", "sun", "ing", "or", "ta", "qui"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(250)]
    vocabulary += [w[:k] + rng.choice("aeé") + w[k + 1 :] for w in vocabulary[:120] for k in (2,)] + [w[:3] + w[4:] for w in vocabulary[:120]]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rng.shuffle(vocabulary)
    out = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 300)))) for k in range(120)]
    out += [(200 + k, out[3][1].swapcase() if k % 2 else out[3][1]) for k in range(9)] + [(201, out[3][1])]
    out += [(300, None), (301, ""), (302, " \n,;"), (None, "alone alone"), (None, None), (None, "Alone alone"), (303, "ÀÉ àé"), (304, "àé àé")]
    long = " ".join(rng.choices(vocabulary, k=30_000))
    return out + [(400, long), (401, long.upper()), (402, long[:-1] + "#"), (403, "#" + long[1:]), (404, "abcdefgh" * 4_000), (405, "abcdefgh" * 4_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Exact copies -----------------------------------------------------------------------------------


def test_chunk_hashes_combine():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 300_001, np.uint8).tobytes()
    want = []
    for base, m in zip(exact_copies.BASES, exact_copies.MODULI):
        value = 0
        for byte in raw:
            value = (value * base + byte) % m
        want.append(value)
    assert exact_copies.chunk_hash(raw) == tuple(want)
    for size in (1, 7, 4_096, 4_097, 65_536, 300_001):
        if size > 1_000:
            chunks = [raw[k : k + size] for k in range(0, len(raw), size)]
            told = [exact_copies.chunk_hash(c, max(0, len(raw) - (k + 1) * size)) for k, c in enumerate(chunks)]
            assert [sum(t[j] for t in told) % m for j, m in enumerate(exact_copies.MODULI)] == want
    assert exact_copies.chunk_hash(b"") == (0, 0)


def copies_by_hand(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(ASCII), []).append(i)
    out = []
    for low, ids in groups.items():
        ids.sort(key=lambda i: -1 if i is None else i)
        sha = hashlib.sha256(low.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("moduli", [exact_copies.MODULI, (3, 2)])
def test_copies_equal_brute_force(docs, rows, moduli):
    """With tiny moduli most texts of a length share a fingerprint: the comparison alone must part them."""
    some = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_copies.copies(docs, moduli=moduli).collect()]
    assert sorted(some, key=str) == copies_by_hand(rows)


def test_texts_of_one_fingerprint_are_parted(spark):
    texts = ["".join(p) for p in ("abc", "acb", "bac", "bca", "cab", "cba", "abc", "cba")]
    rows = list(enumerate(texts))
    got = exact_copies.copies(docs_of(spark, rows), moduli=(1, 1)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == copies_by_hand(rows)


def test_one_row_of_each_text_stays(docs, rows, none):
    kept = exact_copies.without_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "").translate(ASCII)) for r in kept.collect()) == Counter((r[0], low) for low, r in {
        (t or "").translate(ASCII): (i, 0) for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])}.items())
    assert exact_copies.copies(none).count() == 0 and exact_copies.without_copies(none).count() == 0


# Spelling variants ------------------------------------------------------------------------------


def words_by_hand(rows):
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(counts):
    near: dict = {w: [] for w in counts}
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) <= 1 and a < b and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    root = {}
    for w in counts:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


@pytest.mark.parametrize("list_words", [1, 4, 32])
def test_variants_equal_brute_force(spark, docs, rows, none, list_words):
    counts = words_by_hand(rows)
    found = spelling.words(docs)
    assert dict(found.collect()) == counts
    got = spelling.variants(found, list_words).collect()
    want = variants_by_hand(counts)
    assert sum(w[4] > 0 for w in want) > 50 and any(w[1] for w in want)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert spelling.spelling_variants(none).count() == 0


def dictionary_by_hand(words, limit):
    _, left, hashed = spelling._positions(words)
    grams = Counter(h for q, hs in enumerate(hashed, spelling.SHORTEST) for h in hs[left >= q].tolist())
    kept = sorted((h, f) for h, f in grams.items() if f > limit)
    return np.array([h for h, _ in kept], np.uint64), np.array([f for _, f in kept], np.int64)


def test_every_near_pair_has_a_list_in_common():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(700)})
    for limit in (0, 3, 40):
        keys = spelling.keys_of(words, dictionary_by_hand(words, limit))
        for a in range(len(words)):
            for b in range(a):
                if abs(len(words[a]) - len(words[b])) <= 1 and one_edit(words[a], words[b]):
                    assert keys[a] & keys[b], (words[a], words[b], limit)


def test_grams_are_as_long_as_their_lists_ask_for():
    words = ["abcdefg", "abcdefh", "abcxyzz", "qqqqqqq"]
    grams = Counter(f"<{w}>"[a : a + q] for w in words for q in range(2, 7) for a in range(len(w) + 3 - q))
    sizes, lengths, _, numbers = spelling._grams(words, dictionary_by_hand(words, 1))
    at = 0
    for word, size in zip(words, sizes.tolist()):
        marked = f"<{word}>"
        for a in range(size - 1):
            gram = marked[a : a + lengths[at + a]]
            shorter = [marked[a : a + q] for q in range(2, len(gram))]
            assert all(grams[g] > 1 for g in shorter)
            assert grams[gram] <= 1 or len(gram) == spelling.LONGEST or gram.endswith(">")
            assert numbers[at + a] == (grams[gram] if grams[gram] > 1 else 0)
        at += size


def test_a_word_looks_into_short_lists():
    """Words of rare grams look into a few of their lists; only those of frequent grams merge all of them."""
    rare = spelling.keys_of(["variable", "variabel"], dictionary_by_hand(["variable"], 5))
    assert all(len(k) <= 4 for k in rare)
    often = spelling.keys_of(["variable"], dictionary_by_hand(["variable"], 0))
    assert len(often[0]) == 17  # a list for each place
    assert len(spelling.keys_of(["ab" * 20_000], dictionary_by_hand(["variable"], 0))[0]) <= 8


def test_chains_of_forms_end_at_the_root(spark):
    words = [("abcdefgh", 1), ("abcdefgx", 10), ("abcdefyx", 100), ("abcdezyx", 1000), ("abcdezyy", 1000), ("lonely words", 3), ("xxxxxxxx", 5), ("xxxxxxxy", 5)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {
        "abcdefgh": ("abcdefgx", "abcdezyx", 1, 10), "abcdefgx": ("abcdefyx", "abcdezyx", 2, 100), "abcdefyx": ("abcdezyx", "abcdezyx", 2, 1000),
        "abcdezyx": (None, "abcdezyx", 2, None), "abcdezyy": (None, "abcdezyy", 1, None), "lonely words": (None, "lonely words", 0, None),
        "xxxxxxxx": (None, "xxxxxxxx", 1, None), "xxxxxxxy": (None, "xxxxxxxy", 1, None),
    }


# Ranked search ----------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_by_hand(rows, items, top=20):
    docs = [(i, Counter(TERM.findall((t or "").translate(ASCII)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    many, every = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 25 + (25 * c.total() * many) // every
            score = 0
            for t in TERM.findall((text or "").translate(ASCII)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(scores[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(9)
    texts = [" ".join(rng.choices((rows[rng.randrange(120)][1] or "x").split(), k=rng.randrange(1, 40))) for _ in range(40)]
    return [*enumerate(texts), (50, None), (51, ""), (52, "nowhere-to-be-found"), (53, "ALONE, alone; alone"), (None, "alone"), (3, texts[3]), (54, "àé ÀÉ 77")]


def test_ranking_equals_brute_force(spark, docs, rows, items, none):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    want = ranked_by_hand(rows, items)
    for shard_bytes in (search.SHARD_BYTES, 20_000):
        got = search.ranked(docs, asked, shard_bytes=shard_bytes).collect()
        assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == want
    assert search.ranked(none, asked).count() == 0
    assert search.ranked(docs, asked.limit(0)).count() == 0


def test_items_in_several_blocks(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 12)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.ranked(docs, asked).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == ranked_by_hand(rows, items)


def test_hybrid_walk_is_exact_and_skips():
    rng = np.random.default_rng(4)
    size, skipped = 6_000, 0
    lengths = rng.integers(1, 400, size)
    for seed in range(30):
        lists = {}
        for t, share in enumerate([0.9, 0.7, 0.4, 0.2, 0.01, 0.004, 0.002, 0.05][: 3 + seed % 6]):
            found = np.flatnonzero(rng.random(size) < share)
            if len(found):
                lists[t] = found, rng.integers(1, 6, len(found))
        weights = {t: search.weight(size, len(d)) for t, (d, _) in lists.items()}
        shard = search.Shard(lists, lengths, rng.permutation(size), weights, size, int(lengths.sum()))
        query = {t: 1 + t % 3 for t in lists} | {99: 1}
        total = np.zeros(size, np.int64)
        for t in lists:
            total[lists[t][0]] += query[t] * shard.lists[t][1]
        want = np.lexsort((shard.order, -total))[:20]
        want = want[total[want] > 0]
        docs, scores, walked = shard.best(query)
        assert list(docs) == list(want) and list(scores) == list(total[want])
        skipped += size - walked
    assert skipped > 30 * size // 4
