"""The llm operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourspark.llm import chat, components, decontaminate, huffman, mixing, near_copies, quality, queries, sharding, simhash, substring, token_counts, token_files, toxicity

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, TOKEN string, `order` string, key string"


def docs_of(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids."""
    rng = random.Random(3)
    base = words(rng, 300, 5000)
    rows = [(k, " ".join(words(rng, rng.randrange(0, 90))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "en", "a"), (None, "alone " * 30, "en", "b"), (None, None, "de", "b")]
    rows += [(110 + k, " ".join(base), "en", "a") for k in range(5)] + [(110, " ".join(base), "en", "a")]
    rows += [(120 + k, " ".join(base[: 150 + k] + ["new"] + base[150 + k :]), "en", "a") for k in range(4)]
    rows += [(130, " ".join(base[50:90] + words(rng, 30) + base[200:260]), "en", "b"), (131, " ".join(["x", "y"] * 200), "en", "a"), (131, "other text", "en", "a")]
    rows += [(140, " ".join(words(rng, 30_000, 50_000)), "en", "a")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Substrings -------------------------------------------------------------------------------------


def removal_by_hand(rows, size=20):
    order = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in order:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            run = tuple(w[k : k + size])
            if run in seen:
                gone[k : k + size] = [True] * size
            seen.add(run)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_removal_equals_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = removal_by_hand(rows)
    got = substring.removal(odd).collect()
    assert len(got) == len(rows)
    assert sorted((r.o, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((2**63 - 1 if i is None else i, *want[2**63 - 1 if i is None else i, t or ""]) for i, t in rows)


def test_factors_name_earlier_text(spark, odd):
    texts = {(r.o, r.k): r.raw for r in substring._keyed(odd, "doc_id", "text").collect()}
    spans = substring.duplicate_spans(odd)[1].collect()
    assert any(r.factors for r in spans) and any(r.singles for r in spans)
    for r in spans:
        mine = texts[r.o, r.k].split()
        for s in [*r.factors, *(r.singles or [])]:
            length = s["length"] if "length" in s else 20
            there = texts[s.ro, s.rk].split()
            assert mine[s.start : s.start + length] == there[s.rstart : s.rstart + length]
            assert (s.ro, s.rstart) < (r.o, s.start)


def test_minimizers_are_leftmost_least():
    rolled = substring.Rolled(substring.word_hashes([b"a", b"b"] * 30 + [f"{k}".encode() for k in range(100)]))
    grams, at = substring.minimizers(rolled)
    high = grams >> np.uint64(20)
    assert [int(a) for a in at] == [j + int(np.argmin(high[j : j + 13])) for j in range(len(grams) - 12)]


# SimHash ----------------------------------------------------------------------------------------


def linked_by_hand(prints, distance=2):
    own = list(range(len(prints)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return [find(k) for k in range(len(prints))]


def test_close_links_join_what_brute_force_joins(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(40):  # chains
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    hub = rng.getrandbits(64)  # one block with far more than PAIRED_BLOCK fingerprints
    prints += [hub ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 7))) for _ in range(400)]
    prints = sorted({p if p < 2**63 else p - 2**64 for p in prints})
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    want = linked_by_hand([p & (2**64 - 1) for p in prints])
    df = spark.createDataFrame(links, "a long, b long")
    root = {r.node: r.root for r in components.rooted(df).collect()}
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(p for p in prints if root.get(p, p) == r) for r in {root.get(p, p) for p in prints}}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.rooted(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(200)}}


def test_fingerprints_by_definition():
    import xxhash

    text = "The THE ä\xa0b c\x0bd e".encode()
    w = [b"the", b"the", "ä\xa0b".encode(), b"c", b"d", b"e"]
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


def test_near_duplicates_and_the_kept_ones(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    prints = sorted({r.fp for r in rows})
    groups = dict(zip(prints, linked_by_hand([p & (2**64 - 1) for p in prints])))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[groups[r.fp]] = min(least.get(groups[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(groups[r.fp]) for r in rows)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(simhash.fingerprint((r.text or "").encode()) in prints for r in kept.collect())[0]
    assert kept.count() == len(set(groups.values()))


# Token files ------------------------------------------------------------------------------------


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(2)
    counts = np.concatenate([[0, 1], np.array([2**k for k in range(30)]), np.ones(3000, np.int64)]).astype(np.int64)
    bits = huffman.code_lengths(counts)
    assert bits.max() <= huffman.MAX_BITS and bits[0] == 0 and (bits[1:] > 0).all()
    assert sum(2.0 ** -int(b) for b in bits if b) <= 1
    code = huffman.Code(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(1, len(counts), n)
        stream, marks = code.pack(ids)
        assert code.unpack(stream, marks, n).tolist() == ids.tolist()
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1]
    assert sorted(huffman.code_lengths(np.array([10, 1, 1, 1]))) == [1, 2, 3, 3]


def test_token_files_read_back_exactly(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    tricky = ["It's a test, isn't it?", "A <|endoftext|> B", "é, É. İstanbul", "tab\tand\x0bmore...", "x,", ",,", "1, 2. 3", " wide space, ok."]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    token_files.write_token_files(docs, str(tmp_path / "f"), queries.tokenizer_path(), 2)
    got = token_files.read_token_files(spark, str(tmp_path / "f"), with_ids=True).collect()
    at = 0
    rows = sorted(((2**63 - 1 if r.doc_id is None else r.doc_id, r.text is not None, r.text or "", r.doc_id) for r in docs.collect()))
    assert len(got) == len(rows)
    for r, (_, _, text, doc_id) in zip(sorted(got, key=lambda r: r.start), rows):
        ids = np.array(model.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    token_files.write_token_files(none, str(tmp_path / "e"), queries.tokenizer_path(), 2)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


# Mixing and sharding ----------------------------------------------------------------------------


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    """Marks, special tokens, the joining mark and other blanks, also while words are forgotten."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KNOWN_WORDS", 40)
    encoder, whole, rng = token_files.WordEncoder(queries.tokenizer_path(), 2), Tokenizer.from_file(queries.tokenizer_path()), random.Random(8)
    odd_ones = ["a!! b'!s <x| y|z |", "Don't! 'LL,' x.'s... é!?\u0308 q", "a|b|| c <|endoftext|> d", "", None, "x y!\tz#\n\n#k", "ab...cd,.; ab).", "\u017f! \u212a, ß? \u0308x"]
    pieces = ["as", "it", "é", "Ñ", "7", "!", ",", "'s", "|", "<|", "#*", "_", "-", "\u0308", " ", " ", " ", "\n", "\t", "\u00a0"]
    for _ in range(12):
        texts = [*odd_ones, *("".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(30))]
        ids, sizes = encoder.encode(pa.array(texts))
        want = [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


def test_mix_follows_the_queue(spark, odd, none):
    rows = mixing.mix(odd).collect()
    source = {r.doc_id: r.source for r in odd.collect() if r.doc_id is not None}
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in rows)
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    budget = 1.5 * sum(sizes.values())
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share, capped = {}, set()
    while True:  # water filling by hand
        left = budget - sum(2 * sizes[s] for s in capped)
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked) if s not in capped}
        share = {s: left * w / sum(weight.values()) for s, w in weight.items()}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 2 * sizes[s] if s in capped else share[s] for s in sizes}
    for r in rows:
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source[r.doc_id]])
    assert sum(r.taken for r in rows) <= budget + 0.5
    again = mixing.mix(odd.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed(odd).columns == odd.columns


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng, rng.randrange(5, 60))), "en", rng.choice("aaabcdef")) for k in range(3000)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    taken, target = {}, {}
    for r in got:
        s = rows[r.doc_id][3]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 70 for s in taken)


def taken_by_hand(docs, got):
    """Copies of each row: finish times of every source's shuffled documents, ranked and cut at the budget."""
    told = docs.select("doc_id", mixing.row_order("doc_id").alias("o"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("key"), mixing.source_key("source").alias("s"), mixing.word_count("text").alias("size"))
    rows = told.withColumn("turn", F.xxhash64(F.lit(mixing.SEED), "o", "key")).collect()
    target = {r.doc_id: (r.source_size, r.target) for r in got}
    queue, upto = [], {}
    for r in sorted(rows, key=lambda r: (r.s, r.turn, r.o, r.key, r.size)):
        upto[r.s] = upto.get(r.s, 0) + r["size"]
        size, goal = target[r.doc_id]
        queue += [((upto[r.s] + size * k) / goal if goal else 0.0, r.s, r.turn, r.o, r.key, r["size"]) for k in range(2)]
    budget, total, last = sum({r.s: target[r.doc_id][1] for r in rows}.values()) + 0.5, 0, (-1.0,)
    for place in sorted(q for q in queue if q[-1] > 0):
        total += place[-1]
        if total > budget:
            break
        last = place
    counts = {}
    for place in queue:
        counts[place[1:]] = counts.get(place[1:], 0) + (place <= last)
    return sorted((r.doc_id, r["size"], counts[r.s, r.turn, r.o, r.key, r["size"]]) for r in rows)


def test_the_taken_rows_are_the_head_of_the_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 40)
    rng = random.Random(21)
    rows = [(k, " ".join(words(rng, rng.randrange(0, 50))), "en", rng.choice(["a", "b", "c", None, f"rare{k}"])) for k in range(900)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size, r.copies) for r in got) == taken_by_hand(docs, got)


def test_many_sources_that_end_together(spark, monkeypatch):
    """A document a source: finish times are equal, and the end of the budget is found by the rest of the order."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    docs = docs_of(spark, [(k, "w " * (1 + k % 7), "en", f"s{k}") for k in range(1_500)])
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size, r.copies) for r in got) == taken_by_hand(docs, got)


def test_schedule_is_longest_first():
    import pandas as pd

    units = pd.DataFrame({"unit": range(6), "size": [7, 7, 6, 6, 5, 5]})
    placed = dict(zip(*sharding.schedule(units, 3)[["unit", "shard"]].to_numpy().T))
    loads = {s: sum(units["size"][u] for u in placed if placed[u] == s) for s in range(3)}
    assert sorted(loads.values()) == [12, 12, 12]


def test_shards_keep_copies_together(spark, odd, none):
    rows = sharding.sharded(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 131)}
    home = {}
    for r in rows:
        if r.doc_id in texts:
            assert home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
            assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode()))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len(rows) == odd.count() and sharding.sharded(none).count() == 0


def test_one_of_each_of_rows_without_ids(spark):
    rng = random.Random(14)
    base = words(rng, 400, 5000)
    prints = lambda w: simhash.fingerprint(" ".join(w).encode())
    near = next(w for k in range(400) for w in [base[:k] + ["new"] + base[k + 1 :]] if 0 < ((prints(w) ^ prints(base)) & (2**64 - 1)).bit_count() <= 2)
    rows = [(None, " ".join(w), "en", "a") for w in (base, near, base)] + [(None, f"other {k} text", "en", "a") for k in range(50)]
    rows += [(7, " ".join(words(rng, 60, 5000)), "en", "a") for _ in range(20)]
    groups = linked_by_hand([simhash.fingerprint(t.encode()) & (2**64 - 1) for _, t, *_ in rows])
    assert simhash.one_of_each(docs_of(spark, rows)).count() == len(set(groups))


def similar_by_hand(texts):
    """Groups of texts, as the pairs of 5-word Jaccard 0.8 or more join them."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("dealt", [8, 4_096])
def test_one_of_each_leaves_no_similar_pair(spark, odd, none, monkeypatch, dealt):
    monkeypatch.setattr(near_copies, "PAIRED_BLOCK", 6)
    monkeypatch.setattr(near_copies, "DEALT_BLOCK", dealt)
    rng = random.Random(12)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    line = words(rng, 14, 5000)
    for group in range(12):  # chains of copies with ever more changed words, the first ones crowded
        base = words(rng, rng.randrange(20, 200), 5000)
        for k in range(30 if group < 3 else 4):
            base = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                base[rng.randrange(len(base))] = f"new{rng.randrange(9999)}"
            rows.append((1000 + 100 * group + k, " ".join(base + line * (group % 2)), "en", "a"))
    rows += [(3000 + k, " ".join(line + words(rng, rng.randrange(1, 9), 5000)), "en", "a") for k in range(60)]
    docs = docs_of(spark, rows)
    groups = similar_by_hand([r[1] for r in rows])
    least = {}
    for (i, *_), g in zip(rows, groups):
        least[g] = min(least.get(g, 2**63 - 1), 2**63 - 1 if i is None else i)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_copies.one_of_each(none).count() == 0


def test_one_large_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """Texts with up to three words of one text changed: hundreds of pairs of them are similar, as many are not."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(150), 1 + k % 3):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    pairs, written = {}, near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, label: pairs.setdefault(label, []).append(df.count()) or written(df, label))
    kept = near_copies.one_of_each(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert sum(pairs["tries"]) + sum(pairs["apart"]) <= 4 * len(texts)


def test_a_task_tells_each_counted_id_once():
    rows = [np.array(x, "<i8").tobytes() for x in ([0, 2, 0, 5], [1, 2, 0, 0], [0, 0, 0, 1])]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["counts"]) for part in (rows[:2], rows[2:], [])]
    out = [(i, n) for b in token_files._counted(iter(batches)) for i, n in zip(b["id"].to_pylist(), b["count"].to_pylist())]
    assert out == [(0, 1), (1, 4), (3, 6)]
    assert not sum(b.num_rows for b in token_files._counted(iter([])))


def test_spent_step_tables_are_deleted(spark, tmp_path, monkeypatch):
    docs = docs_of(spark, [(k, f"alpha beta {k} gamma delta {k % 3}", "en", "ab"[k % 2]) for k in range(12)])
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    paths: dict[str, list[str]] = {}
    for module in (decontaminate, mixing, token_files):
        def noted(df, label, real=module.written):
            out = real(df, label)
            paths.setdefault(label, []).append(out._written_to)
            return out

        monkeypatch.setattr(module, "written", noted)
    decontaminate.decontaminated(docs, items).count()
    mixing.mixed(docs).count()
    token_files.write_token_files(docs, str(tmp_path / "f"), queries.tokenizer_path(), 2)
    for label in ("passages", "fit", "sizes", "edge", "tokens"):
        assert paths.get(label) and not any(os.path.exists(p) for p in paths[label]), label


def test_near_copies_compare_fingerprints_first(spark, monkeypatch):
    rng, seen = random.Random(5), []
    base = words(rng, 600, 5000)
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(6)] + [" ".join(words(rng, 300, 5000)) for _ in range(4)] + [""]
    prints = {simhash.majority(near_copies.shingles(t.encode()).view(np.uint64)) for t in texts}

    def links(found):
        out = simhash.close_links(found)
        seen.append(({r.fp for r in found.collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(near_copies, "close_links", links)
    kept = near_copies.one_of_each(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6, 7, 8, 9, 10]
    close = {(a, b) for a in prints for b in prints if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(seen) == 1 and seen[0][0] == prints and {frozenset(x) for x in seen[0][1]} == {frozenset(x) for x in close}


def test_sketches_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows, sets = [], []
    for size in (3, 40, 64, 65, 130, 500, 520, 3_000):
        base = rng.integers(-(2**62), 2**62, size)
        for changed in (0, size // 9, size // 5, size // 2):
            kept = base[: size - changed]
            sets.append(np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, changed // 3)])))
    rows = [(k, len(x), near_copies.sketch(x).tolist()) for k, x in enumerate(sets)]
    classes = spark.createDataFrame(rows, "node long, n int, bits array<long>")
    ratio = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a])]
    left = {tuple(r) for r in near_copies._sketched(spark.createDataFrame(pairs, "a long, b long"), classes).collect()}
    similar = {p for p in pairs if ratio(sets[p[0]], sets[p[1]]) >= 0.8}
    assert similar and similar <= left and len(left - similar) < len(pairs) // 3


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline_drops_similar_texts(spark):
    import corpus_pipeline

    docs = queries.table(spark, FOLDER, "documents")
    rows = docs.collect()
    groups = similar_by_hand([r.text for r in rows])
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert len(kept) == len(set(groups)) and len(set(similar_by_hand([r.text for r in kept]))) == len(kept)


# Toxicity ---------------------------------------------------------------------------------------


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.random(len(t))
        rows.append((t, w / (np.linalg.norm(w) or 1)))
    dense = np.zeros((500, 40))
    for k, (t, w) in enumerate(rows):
        dense[k, t] = w
    index = toxicity.Index(rows, 40)
    for t, w in rows[:120]:
        score = dense[:, t] @ w if len(t) else np.zeros(500)
        want = sorted(((-round(float(s), 9), k) for k, s in enumerate(score) if s > 0))[:25]
        assert index.nearest(t, w, 25) == [(-s, k) for s, k in want]


def test_toxicity_on_held_out_rows(spark, odd, none):
    rng = random.Random(6)
    bad = ["zorg", "blarg", "frumpel"]
    rows = []
    for k in range(1200):
        w = words(rng, rng.randrange(5, 60))
        toxic = k % 4 == 0
        if toxic:
            w[:: max(1, len(w) // 3)] = [rng.choice(bad) + rng.choice(["", "s"]) for _ in w[:: max(1, len(w) // 3)]]
        rows.append((k, " ".join(w), int(toxic)))
    docs = docs_of(spark, [(i, t, "en", "a") for i, t, _ in rows]).unionByName(odd.where("doc_id is null or doc_id = 101"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, queries.not_held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) / len(held) > 0.97
    assert all(r.evidence for r in got if r.predicted)
    kept = toxicity.without_toxic(docs, labels, queries.not_held_out())
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    empty = toxicity.toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"), queries.not_held_out())
    assert {r.predicted for r in empty.collect()} == {0}
    assert toxicity.toxicity(none, labels, queries.not_held_out()).count() == 0


# Decontamination --------------------------------------------------------------------------------


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for k, y in enumerate(b):
                row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontaminate.common_words(masks, len(a), b) == row[-1]


def test_planted_passages_are_found(spark, none):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(30)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(20_000)}" for _ in range(n)]
    items = [text(rng.randrange(12, 70)) for _ in range(60)]
    rows, planted = [], set()
    for k in range(800):
        w = text(rng.randrange(0, 400))
        if k % 5 == 0:
            item = rng.randrange(len(items))
            part = [x if rng.random() > 0.08 else "changed" for x in items[item]]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
            if sum(x == "changed" for x in part) <= 0.15 * len(part):
                planted.add((k, item))
        rows.append((k, " ".join(w), "en", "a"))
    docs = docs_of(spark, [*rows, (900, None, None, None), (901, "", None, None)])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(planted - got) <= 0.02 * len(planted) and all(k % 5 == 0 for k, _ in got)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(800)) - {k for k, _ in got} | {900, 901}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_a_full_block_of_unlike_items_is_found_item_by_item(spark):
    rng = random.Random(13)
    items = [[f"i{k}x{j}" for j in range(rng.randrange(12, 30))] for k in range(240)]
    other = [w for item in items for w in item]
    rows = []
    for k, item in enumerate(items):
        w = [rng.choice(other) if rng.random() < 0.1 else f"n{rng.randrange(9999)}" for _ in range(80)]
        at = rng.randrange(81)
        w[at:at] = item
        rows.append((k, " ".join(w), "en", "a"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, rows)
    (space,) = decontaminate.spaces(docs, bench)
    assert space.latent.shape[1] >= len(items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, k) for k in range(len(items))}


def test_the_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    rng = random.Random(14)
    item = [f"q{k}" for k in range(90)]
    texts = [" ".join(rng.choice([*item, "other"]) for _ in range(rng.randrange(0, 130))) for _ in range(1_300)]
    docs = docs_of(spark, [(k, x, "en", "a") for k, x in enumerate(texts)] + [(9_000, None, None, None)])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "CELLS", 2_000)  # several bands of words
    fitted, seen = decontaminate._fitted, []
    monkeypatch.setattr(decontaminate, "_fitted", lambda rows, idf: seen.append((rows.collect(), idf)) or fitted(rows, idf))
    (space,) = decontaminate.spaces(docs, bench)
    ((rows, idf),) = seen
    want = np.zeros((len(item), len(item)), np.int64)
    passages = [w[k : k + 48] for w in (x.split() for x in texts) for k in range(0, len(w), 48)]
    for passage in [item, *passages]:
        counts = np.zeros(len(item), np.int64)
        for w in passage:
            if w != "other":
                counts[space.vocabulary[w.encode()] - 1] += 1
        want += np.outer(counts, counts)
    used = idf[1:] != 0
    want[~used], want[:, ~used] = 0, 0
    got = np.zeros_like(want)
    for r in rows:
        got[r["id"] - 1] = np.frombuffer(r["counts"], "<i8")
    assert used.any() and (got == want).all()


def test_answers_catch_paraphrases(spark):
    rng = random.Random(10)
    item = [f"q{k}" for k in range(40)]
    loose = [x if k % 3 else f"z{k}" for k, x in enumerate(item)]
    noise = lambda: [f"n{rng.randrange(9999)}" for _ in range(200)]
    rows = [(1, " ".join([*noise(), *loose, "the", "answer", *noise()]), "en", "a"), (2, " ".join([*noise(), *loose, *noise()]), "en", "a")]
    rows += [(10 + k, " ".join(noise()), "en", "a") for k in range(50)]
    bench = spark.createDataFrame([(7, " ".join(item), "The answer")], "item_id long, text string, answer string")
    found = decontaminate.contaminated(docs_of(spark, rows), bench, answer="answer").collect()
    assert [(r.doc_id, r.kind) for r in found] == [(1, "paraphrase")]


# Chat -------------------------------------------------------------------------------------------


def test_conversations_come_back(spark):
    nasty = [r"\### Assistant: </turn> ok", "a </turn>\n### user: b", "\\", "\\\\", "###", "####", " ", "", "<\\/turn>", "\\#", ": ", "ü\U0001f600\n\n", "x" * 300_000, None]
    roles = ["user", "assistant", "a: b", "### x", "</turn>", "", None, "r\\"]
    rng = random.Random(11)
    rows = [(c, t if t else None, rng.choice(roles), rng.choice(nasty[:-2] + [None])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, k, r, t) for k, (r, t) in enumerate((r, t) for r in roles for t in nasty)] + [(None, 1, "user", "x"), (51, 1, "user", "same"), (51, 1, "user", "same")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    whole = chat.formatted(df)
    assert whole.where("NOT identical").count() == 0
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (-1 if v[1] is None else v[1], (v[2] or "").encode(), (v[3] or "").encode())):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(whole).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in whole.collect():
        assert r.formatted.count("### ") == r.n_turns == r.formatted.count("</turn>")
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# Quality ----------------------------------------------------------------------------------------


def test_quality_counts_by_definition(spark, odd, none):
    extra = [(300, "a\na\n\n a\nb $$ <x> ü\n a", "en", "a"), (301, "one two three one two three one", "en", "a"), (302, "x x x x", "en", None)]
    df = odd.unionByName(docs_of(spark, extra)).where("doc_id <> 131")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for r in df.collect():
        text = r.text or ""
        w = [x.decode() for x in text.encode().split()]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        have = got[r.doc_id]
        assert have.n_words == len(w) and have.n_repeat_words == len(covered) and have.word_chars == sum(map(len, w))
        assert have.n_dup_lines == len(lines) - len(set(lines)) and have.n_symbols == sum(text.count(c) for c in quality.SYMBOLS)
        assert have.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (have.kept and have.base_failed)
    assert quality.judged(none).count() == 0


def test_sketches_merge_and_bound_their_error(spark):
    values = [0, 1, 63, 64, 65, 1000, 1001, 123_456]
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bin_floor(F.col("v"))).collect()]
    assert all(b <= v and v - b <= v / 32 for b, v in zip(bins, values)) and bins[:3] == [0, 1, 63]


def test_thresholds_adapt_to_the_group(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(w + ("#" * (k % 3) if s == "code" else "") for w in words(rng, 80)), "en", s) for k, s in enumerate(["code", "prose"] * 400)]
    rows += [(900, " ".join(f"{w}##" for w in words(rng, 80)), "en", "code"), (901, " ".join(f"{w}##" for w in words(rng, 80)), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality.judged(docs_of(spark, rows)).collect()}
    assert got[900] and not got[901] and sum(got.values()) >= 800


# Token counts -----------------------------------------------------------------------------------


def test_totals_follow_inserts_deletes_and_revisions(spark, tmp_path):
    rng = random.Random(13)
    state, folder = {}, str(tmp_path / "counts")
    for batch in range(4):
        changes = []
        for _ in range(40):
            key = (rng.choice([None, *range(12)]), rng.choice(["v1", "v2"]))
            changes.append((*key, rng.choice(["a", None]), "en", rng.choice([None, 3, 9]), rng.choice(["put", "put", "delete"])))
        news = {}
        for d, v, s, lang, n, op in changes:
            order = (op == "put", n or 0, s is not None, s or "", lang)
            if (d, v) not in news or order > news[d, v][0]:
                news[d, v] = (order, s, lang, n or 0)
        for key, (order, *value) in news.items():
            state[key] = value
            if not order[0]:
                del state[key]
        df = spark.createDataFrame(changes, "doc_id long, version string, source string, lang string, tokens long, op string")
        assert token_counts.commit(spark, folder, f"b{batch}", df)
        assert not token_counts.commit(spark, folder, f"b{batch}", df)  # delivered again
        want = {}
        for (_, v), (s, lang, n) in state.items():
            d, t = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (d + 1, t + n)
        got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in token_counts.totals(spark, folder).collect()}
        assert got == want


def test_rows_without_ids_and_of_one_id_are_counted_apart(spark, tmp_path, odd, none):
    """The query's batches over null, repeated and copied rows, against its SQL and by hand."""
    rows = odd.select("doc_id", "text", "lang", "source").collect()
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in queries.rolled_up(odd).collect()}
    firsts, want = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.source is not None, r.source or "", r.lang is not None, r.lang or ""), reverse=True):
        firsts[r.text or ""] = r
    for text, r in firsts.items():
        n = len(text.split())
        if n:
            for version, tokens in (("words-2", n + text.count("\n")), ("chars-1", (len(text) + 3) // 4)):
                d, t = want.get((r.source, r.lang, version), (0, 0))
                want[r.source, r.lang, version] = (d + 1, t + tokens)
    assert {k[2]: sum(v[0] for x, v in got.items() if x[2] == k[2]) for k in got} == {k[2]: sum(v[0] for x, v in want.items() if x[2] == k[2]) for k in want}
    assert {k[2]: sum(v[1] for x, v in got.items() if x[2] == k[2]) for k in got} == {k[2]: sum(v[1] for x, v in want.items() if x[2] == k[2]) for k in want}
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang", "source").toArrow())
    told = con.execute(queries.ORACLES["op6_token_counts"]).fetchall()
    for version in ("words-2", "chars-1"):
        assert (sum(r[3] for r in told if r[2] == version), sum(r[4] for r in told if r[2] == version)) == tuple(map(sum, zip(*(v for k, v in got.items() if k[2] == version))))
    assert queries.rolled_up(none).count() == 0


def test_copies_states_and_compaction(spark, tmp_path):
    folder = str(tmp_path / "counts")
    change = lambda *rows: spark.createDataFrame(rows, "doc_id long, text_key string, version string, source string, lang string, tokens long, copies long, op string")
    row = lambda i, k, n, c, op="put": (i, k, "v", "s", "en", n, c, op)
    total = lambda: [(r.documents, r.tokens) for r in token_counts.totals(spark, folder).collect()]
    token_counts.commit(spark, folder, "a", change(row(None, "x", 5, 3), row(None, "y", 7, 1), row(1, "x", 5, 1), row(1, "z", 2, 2)))
    assert total() == [(7, 31)]
    token_counts.compact(spark, folder)
    token_counts.commit(spark, folder, "b", change(row(None, "x", 5, 1), row(1, "z", 0, 0, "delete"), row(2, "q", 0, 0, "delete")))
    token_counts.commit(spark, folder, "c", change())
    assert total() == [(3, 17)]
    token_counts.compact(spark, folder)
    token_counts.commit(spark, folder, "d", change(row(None, "x", 6, 2), row(1, "z", 2, 1)))
    assert total() == [(5, 26)] and not token_counts.commit(spark, folder, "b", change())
    assert token_counts._claimed(spark, folder, 1) == 5  # four commits hold the first ordinals


# Queries and the pipeline -----------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    found = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == columns
    want = found.fetchall()
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = queries.table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        seen[name] = docs
        if name != "token_files":
            assert docs.columns == columns
            assert docs.exceptAll(before.unionAll(before)).count() == 0
    assert seen["near_duplicates"].count() == seen["near_duplicates"].select("doc_id").distinct().count()
    items = [decontaminate.words_of(r.text.encode()) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    for r in seen["decontamination"].collect():
        text = b" ".join(decontaminate.words_of((r.text or "").encode()))
        assert not any(b" ".join(w) in text for w in items)
    assert seen["token_files"].count() == seen["mixing"].count()
    assert sorted(r.doc_id for r in seen["token_files"].collect()) == sorted(r.doc_id for r in seen["mixing"].collect())
