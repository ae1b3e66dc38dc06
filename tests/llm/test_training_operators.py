"""The training-data operators against brute force, round trips and small cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from strata.llm import leakage, mixing, neardup, queries, repeated_lines, residue, splitting, words

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0


# words


def test_words_are_those_of_the_pattern():
    texts = ["Ab-c 12é x", None, "", "ß ab", "AB c", "a" * 5000]
    hashes, offsets = words.word_hashes(texts)
    want = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    assert list(np.diff(offsets)) == [len(w) for w in want]
    by_word: dict[str, set] = {}
    for i, ws in enumerate(want):
        for k, w in enumerate(ws):
            by_word.setdefault(w, set()).add(int(hashes[offsets[i] + k]))
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)


# repeated lines


def lines_of(rows, cfg):
    """Brute force of the definition for blocks of cfg.min_lines lines."""
    form = lambda x: re.sub("[^a-z#]+", " ", re.sub("[0-9]+", "#", x.lower())).strip(" ")
    docs = [(r, s, [form(x) for x in t.split("\n")]) for r, s, t in rows if s is not None and t is not None]
    out, m = set(), cfg.min_lines
    for source in {s for _, s, _ in docs}:
        own = [(r, f) for r, s, f in docs if s == source]
        spread: dict[tuple, set] = {}
        for r, f in own:
            for i in range(len(f) - m + 1):
                if all(len(x) >= cfg.min_chars for x in f[i : i + m]):
                    spread.setdefault(tuple(f[i : i + m]), set()).add(r)
        for r, f in own:
            for i in range(len(f) - m + 1):
                n = len(spread.get(tuple(f[i : i + m]), ()))
                if n >= cfg.min_rows and n >= cfg.min_share * len(own):
                    out |= {(r, i + k) for k in range(m)}
    return out


@pytest.mark.parametrize(("min_lines", "shard"), [(1, 200_000), (1, 40), (2, 40)])
def test_lines_equal_brute_force(spark, min_lines, shard):
    rnd = random.Random(2)
    notices = ["Subscribe to alerts and get the next filing 12", "All rights are reserved by the company", "Was this page useful to you? Yes (3)", "short"]
    rows = []
    for i in range(120):
        body = [rnd.choice(notices) if rnd.random() < 0.4 else f"Body line number {rnd.choice('abcdefgh')}{rnd.choice('ijklmnop')}{rnd.choice('qrstuv')} of it" for _ in range(rnd.randint(0, 8))]
        if i % 3 == 0:
            body += notices[:2]
        rows.append((i, rnd.choice(["A", "A", "B", None]), "\n".join(body) if i % 17 else None))
    rows += [(500, "A", ""), (501, "C", notices[0]), (502, "C", notices[0])]
    cfg = repeated_lines.RepeatedLinesConfig(min_lines=min_lines, shard_lines=shard)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record bigint, source string, text string, ids string, shards int")
    found = repeated_lines.repeated_lines(df, cfg).occurrences()
    want = lines_of(rows, cfg)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) and want
    kept = {r["record"]: r["text"] for r in repeated_lines.remove_lines(df, found).collect()}
    for r, _, t in rows:
        assert kept[r] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r, i) not in want))


def test_maximal_blocks(spark):
    block = ["First line of the notice here", "Second line of the notice here", "Third line of the notice here"]
    rows = [(i, "A", "\n".join([f"Own words {chr(97 + i)} of this very record", *block, f"And {chr(97 + i)} closing words of the record"])) for i in range(10)]
    got = repeated_lines.repeated_lines(spark.createDataFrame(rows, "record bigint, source string, text string")).maximal().collect()
    assert [(r["lines"], r["records"], r["line"]) for r in got] == [(3, 10, 1)]


def test_suffix_array_is_sorted():
    rnd = random.Random(4)
    for _ in range(30):
        s = np.array([rnd.choice([0, 1, 2, 3]) for _ in range(rnd.randint(0, 60))] + [0], dtype=np.int64)
        order, lcp = repeated_lines.suffix_array(s)
        tail = lambda i: list(s[i : i + next(k for k in range(len(s) - i) if s[i + k] == 0)])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sorted(order) == list(range(len(s)))
        assert all(lcp[k] == common(tail(order[k - 1]), tail(order[k])) for k in range(1, len(s)))


def test_intervals_count_records_once():
    rnd = random.Random(7)
    for _ in range(60):
        docs = [[rnd.choice([1, 2, 3]) for _ in range(rnd.randint(0, 7))] for _ in range(rnd.randint(1, 8))]
        shard = repeated_lines._Shard(np.arange(len(docs)), [np.array(d, dtype=np.int64) for d in docs])
        order, lcp = repeated_lines.suffix_array(shard.symbols)
        got = repeated_lines.intervals(lcp, shard.owner[order])
        spread: dict[tuple, list] = {}
        for r, d in enumerate(docs):
            for i in range(len(d)):
                for j in range(i + 1, len(d) + 1):
                    spread.setdefault(tuple(d[i:j]), []).append(r)
        seen = {tuple(shard.symbols[order[f] : order[f] + h]): (l - f + 1, n) for h, f, l, n in zip(got.depth, got.first, got.last, got.records)}
        assert len(seen) == len(got.depth) and all(seen[b] == (len(spread[b]), len(set(spread[b]))) for b in seen)
        # blocks that can be followed by different lines are just the intervals
        branching = {b for b, at in spread.items() if len(at) > 1 and not any(len(spread.get((*b, x), ())) == len(at) for x in (1, 2, 3))}
        assert branching == set(seen)
        assert all(p < 0 or (got.depth[p] < got.depth[k] and got.first[p] <= got.first[k] <= got.last[k] <= got.last[p]) for k, p in enumerate(got.parent))


@pytest.mark.parametrize("shard", [200_000, 30])
def test_maximal_blocks_equal_brute_force(spark, shard):
    rnd = random.Random(5)
    name = lambda k: f"Standing line {'abcdefgh'[k]} of the printed notice"
    rows = [(i, "A", "\n".join([f"Own {chr(97 + i % 26)}{chr(97 + i // 26)} words of this very record", *[name(k) for k in rnd.choice([(0, 1, 2), (1, 2), (3,), (0, 1, 2, 3), (4, 5), (5,)])]])) for i in range(90)]
    got = repeated_lines.repeated_lines(spark.createDataFrame(rows, "record bigint, source string, text string"), repeated_lines.RepeatedLinesConfig(shard_lines=shard)).maximal().collect()
    spread: dict[tuple, set] = {}
    for r, _, t in rows:
        parts = t.split("\n")
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                spread.setdefault(tuple(parts[i:j]), set()).add(r)
    often = {b: len(s) for b, s in spread.items() if len(s) >= 6}
    text = {r: t.split("\n") for r, _, t in rows}
    want = {b: n for b, n in often.items() if not any(len(c) == len(b) + 1 and b in (c[1:], c[:-1]) for c in often)}
    assert {tuple(text[r["record"]][r["line"] : r["line"] + r["lines"]]): r["records"] for r in got} == want and len(got) == len(want)


def test_copies_of_a_long_record(spark):
    body = "\n".join(f"Line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long copied record" for i in range(3000))
    found = repeated_lines.repeated_lines(spark.createDataFrame([(i, "A", body) for i in range(8)], "record bigint, source string, text string"))
    assert found.occurrences().count() == 8 * 3000
    assert [(r["lines"], r["records"], r["line"]) for r in found.maximal().collect()] == [(3000, 8, 0)]


def test_lines_of_nothing(spark):
    df = spark.createDataFrame([], "record bigint, source string, text string")
    found = repeated_lines.repeated_lines(df)
    assert found.occurrences().count() == 0 and found.maximal().count() == 0 and repeated_lines.remove_lines(df, found.occurrences()).count() == 0


# splitting


@pytest.mark.parametrize("overlap", [0, 200])
def test_pieces_hold_the_text(overlap):
    rnd = random.Random(7)
    cfg = splitting.SplitConfig(2000, overlap)
    texts = ["", "  \n ", "a" * 2000, " " + "a" * 2000 + "\n", "a" * 2001, "x" * 20_000, "日本語。" * 3000, "word " * 5000, "\n\n".join("Sentence one, of two. Next! " * rnd.randint(1, 150) for _ in range(20)), "".join(rnd.choice("ab .,\n\té𝒳") for _ in range(30_000))]
    for text in texts:
        pieces = splitting.split_text(text, cfg)
        body = text.strip(splitting.BLANKS)
        assert (len(pieces) > 1) == (len(body) > 2000) and bool(pieces) == bool(body)
        for i, p in enumerate(pieces):
            assert len(p.text) <= 2000 and p.text == text[p.start : p.end] and p.text.strip(splitting.BLANKS) == p.text and p.core - p.start <= overlap
            if i:
                assert text[pieces[i - 1].end : p.core].strip(splitting.BLANKS) == "" and p.start <= p.core
        assert re.sub(r"[ \t\r\n]", "", "".join(text[p.core : p.end] for p in pieces)) == re.sub(r"[ \t\r\n]", "", body)


def test_cuts_prefer_strong_boundaries():
    text = "\n\n".join(["Some words of a sentence here. " * 30] * 6)
    pieces = splitting.split_text(text, splitting.SplitConfig(2000, 0))
    assert all(text[: p.start].rstrip(" ").endswith("\n") for p in pieces[1:])


def test_pieces_equal_plain_agglomeration():
    """Merging from single words on, the weakest boundary first, gives the same cuts."""
    rnd = random.Random(12)
    for _ in range(60):
        text = "".join(rnd.choice(["ab", "cde", "f", "ghijk"]) + rnd.choice([" ", " ", ", ", "! ", "\n", "\n\n"]) for _ in range(rnd.randint(10, 60))) + "z"
        cfg = splitting.SplitConfig(30, 0)
        strength: dict[int, int] = {}
        for level in reversed(range(len(splitting._LEVELS))):
            strength.update(dict.fromkeys(splitting._places(text, 0, len(text), level), splitting._LEVELS[level][0]))
        ends = [0, *sorted(strength), len(text)]
        while len(text) > 30:
            fits = [(strength[ends[k]], ends[k + 1] - ends[k - 1], k) for k in range(1, len(ends) - 1) if ends[k + 1] - ends[k - 1] <= 30]
            if not fits:
                break
            del ends[min(fits)[2]]
        if len(text) > 30:
            cores = [len(text) - len(text[e:].lstrip(splitting.BLANKS)) for e in ends[:-1]]
            assert [p.core for p in splitting.split_text(text, cfg)] == list(dict.fromkeys(cores))


def test_shortened_words_end_no_sentence():
    text = "It was sold in the U.S. Market and by Apple Inc. Designers there. " * 60
    pieces = splitting.split_text(text, splitting.SplitConfig(300, 80))
    assert all(text[: p.core].endswith("there. ") and text[: p.start].endswith("there. ") or p.start == 0 for p in pieces)


def test_sections_of_any_kind(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "w " * 3000, "x"), (4, "w " * 3000, "x")], "key bigint, text string, chunk_index string")
    got = splitting.split_sections(df).groupBy("key").agg(F.count("*").alias("n"), F.max("total_chunks_in_section").alias("t")).collect()
    assert {r["key"]: (r["n"], r["t"]) for r in got if r["key"] == 3} == {3: (1, 1)} and {r["key"] for r in got} == {3, 4}
    assert splitting.split_sections(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.SplitConfig(100, 100)


# near-duplicates


def grams(text, n):
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def pairs_of(rows, cfg):
    sets = {i: grams(t, cfg.shingle) for i, t in rows if t is not None and len(re.findall("[a-z0-9]+", t.lower())) >= cfg.min_words}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= cfg.threshold * len(sets[a] | sets[b])}


def edited(rnd, base, edits):
    out = list(base)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        if rnd.random() < 0.5:
            out[k] = rnd.choice(WORDS)
        else:
            out.insert(k, rnd.choice(WORDS))
    return out


@pytest.mark.parametrize(("shingle", "threshold", "cell"), [(3, 0.5, 200_000), (5, 0.8, 200_000), (3, 0.5, 40)])
def test_near_duplicates_equal_brute_force(spark, shingle, threshold, cell):
    rnd = random.Random(1)
    rows, i = [], 0
    for _ in range(60):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(40, 160))]
        for _ in range(rnd.randint(1, 4)):
            rows.append((i, " ".join(edited(rnd, base, rnd.choice([0, 1, 3])))))
            i += 1
    hot = [rnd.choice(WORDS) for _ in range(80)]  # one group holds a third of the rows
    rows += [(1000 + k, " ".join(hot if k % 2 else edited(rnd, hot, 1))) for k in range(80)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "é" * 50), (2004, " ".join(WORDS * 50))]
    cfg = neardup.NearDupConfig(shingle=shingle, threshold=threshold, min_words=30, cell_rows=cell, part_rows=500, copies=2)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "id bigint, text string, a int, rep string").repartition(3)
    found = neardup.near_duplicates(df, cfg)
    got = [tuple(r) for r in neardup.expand_pairs(found, cfg).collect()]
    want = pairs_of(rows, cfg)
    assert len(got) == len(set(got)) and set(got) <= set(want)
    sure = {p for p, s in want.items() if s >= threshold + 0.1}
    assert len(set(got) & sure) >= 0.99 * len(sure) and len(got) >= 0.97 * len(want)
    groups = {r["id"]: r["group_id"] for r in neardup.groups(found).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and len(groups) == sum(1 for _, t in rows if t and len(re.findall("[a-z0-9]+", t.lower())) >= 30)


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "id bigint, text string"), neardup.NearDupConfig())
    assert neardup.expand_pairs(found).count() == 0 and neardup.groups(found).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame([*chain, *star, (5, 5)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


# leakage


def longest_common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    items = [(f"q{i}", part, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([5, 12, 40])))) for i in range(20) for part in ("question", "passage")] + [("q0", "passage", None), ("q1", "passage", "")]
    docs = []
    for d in range(150):
        own = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 80))]
        if d % 3 == 0:
            src = items[rnd.randrange(40)][2].split()
            n = rnd.choice([8, 11, 12, 13, 30])
            k = rnd.randrange(max(1, len(src) - n + 1))
            at = rnd.randint(0, len(own))
            own[at:at] = src[k : k + n]
        docs.append((d, ("; " if d % 2 else " ").join(own).upper()))
    docs += [(500, None), (501, "")]
    for cfg in (leakage.LeakConfig(), leakage.LeakConfig(block_seeds=50), leakage.LeakConfig(min_match=5, min_longest=12)):
        got = leakage.leaks(spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, id string"), spark.createDataFrame(items, "id string, part string, text string"), cfg).collect()
        want = {(d, i, p) for d, t in docs if t for i, p, s in items if s and longest_common_run(s.split(), re.findall("[a-z0-9]+", t.lower())) >= 12}
        assert {(r["doc_id"], r["id"], r["part"]) for r in got} == want and len(got) == len(want) and want


def test_reordered_passages_are_covered(spark):
    rnd = random.Random(9)
    item = [rnd.choice(WORDS) for _ in range(60)]
    doc = item[40:] + WORDS[:10] + item[:20] + WORDS[10:20] + item[20:40]
    got = leakage.leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string"), spark.createDataFrame([("q", "passage", " ".join(item))], "id string, part string, text string"), leakage.LeakConfig(min_match=8, min_coverage=0.9)).collect()
    assert [(r["tiles"], r["matched"], r["words"]) for r in got] == [(3, 60, 60)]


def test_tiles_never_overlap():
    a = "a b c d e f g h".split()
    doc = "c d e f g x a b c d".split()
    starts = [(i, j) for i in range(7) for j in range(9) if a[i : i + 2] == doc[j : j + 2]]
    assert leakage.tiles(a, doc, starts, 2) == [(2, 0, 5), (0, 6, 2)]


def test_tiles_equal_plain_greedy_tiling():
    rnd = random.Random(11)
    for _ in range(80):
        part, doc = ([rnd.choice("abc") for _ in range(rnd.randint(3, 25))] for _ in range(2))
        least = rnd.choice([2, 3, 4])
        free_part, free_doc, want = [True] * len(part), [True] * len(doc), []
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(part)):
                for j in range(len(doc)):
                    n = 0
                    while i + n < len(part) and j + n < len(doc) and part[i + n] == doc[j + n] and free_part[i + n] and free_doc[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                break
            want.append((i, j, n))
            free_part[i : i + n], free_doc[j : j + n] = [False] * n, [False] * n
        starts = [(i, j) for i in range(len(part) - least + 1) for j in range(len(doc) - least + 1) if part[i : i + least] == doc[j : j + least]]
        assert leakage.tiles(part, doc, starts, least) == want


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert leakage.leaks(docs, spark.createDataFrame([], "id string, part string, text string")).count() == 0


# mixing

TOKENIZER = pytest.mark.skipif(not __import__("os").path.exists(mixing.TOKENIZER), reason="no tokenizer files")


@TOKENIZER
def test_mixture_meets_its_shares(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice([" Big", "big", "BIG "]) if i % 3 else "small", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 60)))) for i in range(900)]
    docs += [(5000, None, "x"), (5001, "big", None), (5002, "big", ""), (5003, "none", "x y"), (5004, "  ", "x")]
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.7, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, tokens int")
    mix = mixing.mix(df, targets, mixing.MixConfig(block_tokens=256, bucket_documents=100, slot_chunk=16, exact=True))
    slots, shares = mix.slots.collect(), {r["source"]: r for r in mix.shares.collect()}
    assert set(shares) == {"big", "small", "absent"} and shares["absent"]["tokens"] == 0
    assert abs(shares["small"]["actual_share"] - 7 / 9) < 0.01 and abs(shares["big"]["actual_share"] - 2 / 9) < 0.01
    uses: dict = {}
    for r in slots:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert max(uses.values()) <= 3 and all(n == 1 for d, n in uses.items() if docs[d][1] != "small")
    assert sum(r["tokens"] for r in slots) == sum(r["tokens"] for r in shares.values()) and len({(r["doc_id"], r["round"]) for r in slots}) == len(slots)
    half = sorted(slots, key=lambda r: r["slot"])[: len(slots) // 2]
    assert abs(sum(r["tokens"] for r in half if r["source"] == "small") / sum(r["tokens"] for r in half) - 7 / 9) < 0.05  # even along the mixture


@TOKENIZER
def test_mixture_beyond_what_there_is(spark):
    docs = spark.createDataFrame([(i, "a" if i < 3 else "b", "one two three four") for i in range(6)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mix(docs, targets, mixing.MixConfig(total_tokens=1000)).shares.collect()}
    assert shares["a"]["uses"] == 6 and shares["b"]["uses"] == 3 and shares["a"]["repeats"] == 2
    assert shares["a"]["wanted"] == shares["a"]["tokens"] == 24 and shares["a"]["short"] == 900 - 24 and shares["b"]["short"] == 100 - 12


@TOKENIZER
def test_default_size_and_shortage(spark, duck):
    """One target source is scarce: the others keep their share of the budget, the scarce one gives all it may, and the report says so."""
    rnd = random.Random(8)
    docs = [(i, "plenty" if i < 400 else "enough" if i < 800 else "scarce", " ".join(rnd.choice(WORDS) for _ in range(20))) for i in range(805)]
    targets = [("plenty", 0.3, 1), ("enough", 0.4, 2), ("scarce", 0.3, 3)]
    mix = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), mixing.MixConfig(block_tokens=128))
    shares, slots = mix.shares.toPandas(), mix.slots.toPandas()  # noqa: F841
    duck.register("shares", shares)
    duck.register("slots", slots)
    off = duck.execute("""SELECT count(*) FROM shares JOIN (SELECT source, sum(tokens) AS t, count(*) AS u, max(n) AS most, sum(sum(tokens)) OVER () AS every
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM slots) GROUP BY source) g USING (source)
        WHERE t <> tokens OR u <> uses OR most > max_repeats OR abs(t / every - actual_share) > 1e-9""").fetchone()[0]
    by = shares.set_index("source")
    budget = by["available"].sum()
    assert off == 0 and by.loc["scarce", "tokens"] == 3 * by.loc["scarce", "available"] and by.loc["scarce", "short"] > 0
    assert all(0 <= by.loc[s, "tokens"] - int(budget * w) < 100 for s, w in (("plenty", 0.3), ("enough", 0.4))) and by.loc["plenty", "short"] == 0


def test_slots_are_spread_evenly(spark):
    plan = spark.createDataFrame([("a", 700), ("b", 299), ("c", 1)], "source string, wanted bigint")
    got = sorted((r["slot"], r["source"], r["block"]) for r in mixing._schedule(plan, mixing.MixConfig(block_tokens=1, slot_chunk=64)).collect())
    assert len({s for s, _, _ in got}) == 1000
    for source, n in (("a", 700), ("b", 299), ("c", 1)):
        assert [b for _, s, b in got if s == source] == list(range(n))
        for m in range(1, 1001, 37):
            assert abs(sum(s == source for _, s, _ in got[:m]) - m * n / 1000) < 12


@TOKENIZER
def test_mixture_of_nothing(spark):
    mix = mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert mix.slots.count() == 0 and [(r["tokens"], r["actual_share"]) for r in mix.shares.collect()] == [(0, 0.0)]


# residue

CASES = [
    "As of {{ plantName }}, the mills were pledged.", "Our auditor, <%= total %>, has served.", "X paid [TBD] for shops.", "Dear holders of [insert segment here], hello.", "Dear holders of (fill in\nperiod end), hello.", "Paid $[____] for it.", "As of XX/XX/20XX, it was.",
    "By «share count», held.", "Net sales of &lt;total&gt; were", "as of [●],", "__NET_SALES__ reported", "@@TICKER@@ reported", "%(total)s reported", "<Period End Here> reported", "[auditor to come] reported",
    "Lorem ipsum dolor.", "dummy dummy dummy dummy dummy", "xxx xxxx xx xxxxx xxx", "foo bar foo bar foo bar foo bar", "Put your text here ...", "Your caption in this box.", "Sample heading.", "Content coming soon - stub", "TODO write this part TODO", "Hier steht Ihr Text. Bitte ersetzen.", "Votre texte ici. À remplacer.",
    "Error 404: the filing page you asked for does not exist.", "403 Forbidden.", "Bad gateway (code 502)", "Your session has timed out.", "Access denied: automated tools are not allowed.", "Page expired.", "Fehler 404: Seite nicht gefunden.", "Votre session a expiré.", "sorry, we couldn't find that page. it may have moved.", "Traceback: KeyError in render_section, line 301",
    "Real text first.\n\nPlease enable JavaScript to view this report.", "JavaScript is disabled. Activate it.", "Scripts off? Switch it on.", "Your browser has blocked JavaScript, so we cannot show it.", "This viewer does not work without scripting.", "Bitte aktivieren Sie JavaScript, um zu lesen.", "> Please enable\n> JavaScript to view", "You must activate Javascript for this page.",
]
FINE = [
    "Customers of X must enable JavaScript in the ordering portal, and outages there delayed catalogues.", "Page 404 of the exhibit names inventories.", "Server errors at the data hall interrupted plants for 404 minutes.", "Access to X was denied to visitors while foundries were rebuilt.", "A template supplied by X is used to prepare credit lines.",
    "The session of the X council expired before it was voted on.", "Item 6 of the report reads [Reserved].", "See X [12] and the schemes of [3, 4].", "Years {2021, 2022, 2023} are shown.", 'The record {"site": "B", "status": "idle"} lists halls.', "Plant 503 near X replaced hubs (internal code <B7>).", "Section 404 testing covered systems and found no weakness.",
    "X sells blank forms, dummy meters and hubs.", "A script written in JavaScript runs accounts.", "Cookies and biscuits from X outsold hubs.", "Unit price of $[sic] 12 applied.", "The X programme inserts cards into plants before shipment.", "Home | Contact | Help", "", None,
]


def test_evidence():
    assert [t for t in CASES if residue.evidence(t) is None] == []
    assert [(t, residue.evidence(t)) for t in FINE if residue.evidence(t)] == []


def sample(rnd, tree):
    """A text of a parsed pattern; looking around is left out."""
    c, out = re._constants, []
    for op, a in tree:
        if op is c.LITERAL:
            out.append(chr(a))
        elif op in (c.NOT_LITERAL, c.ANY):
            out.append("q")
        elif op is c.IN:
            kind, v = rnd.choice([x for x in a if x[0] is not c.NEGATE])
            out.append("q" if a[0][0] is c.NEGATE else chr(v) if kind is c.LITERAL else chr(rnd.randint(*v)) if kind is c.RANGE else {c.CATEGORY_DIGIT: "4", c.CATEGORY_SPACE: " "}.get(v, "q"))
        elif op is c.BRANCH:
            out.append(sample(rnd, rnd.choice(a[1])))
        elif op is c.SUBPATTERN:
            out.append(sample(rnd, a[3]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += [sample(rnd, a[2]) for _ in range(rnd.randint(a[0], min(a[1], a[0] + 2)))]
    return "".join(out)


@pytest.mark.parametrize("kind", range(len(residue.PATTERNS)))
def test_every_form_holds_a_piece(kind):
    rnd = random.Random(kind)
    name, pattern, pieces = residue.PATTERNS[kind]
    seen, without = 0, set()
    for part in getattr(residue, {"slot": "_SLOTS", "filler": "_FILLER", "error": "_ERROR", "script": "_SCRIPT"}[name]):
        texts = [residue.views(sample(rnd, re._parser.parse(part, re.IGNORECASE)))[1] for _ in range(400)]
        texts = [t for t in texts if re.search(part, t, re.IGNORECASE)]
        seen += bool(texts)
        without |= {t for t in texts if not any(p in " ".join(t.lower().split()) for p in pieces)}
    assert without == set() and seen > 10


@pytest.mark.parametrize("text", ["Status: 503", "Status 404.", "Made on ( insert date ).", "Made on (  fill in date).", "401 signin required", "Put your text (here)."])
def test_pieces_let_pass(text):
    assert residue.evidence(text) is not None


LONG = "the full legal name of the registrant as it stands in the charter\nfollowed by the state and the date of the last amendment"


@pytest.mark.parametrize(
    "text",
    ["Total {{ total|round }}.", "{{ x | default('none') }} paid", "{{1}} paid", "{% if x == 'a' %} yes", "<%= total.round(2) %> paid", f"Paid by [insert {LONG}].", f"Paid by (fill in {LONG}).", f"[{LONG} to be confirmed]", *(f"Paid by {a}{LONG}{z}." for a, z in (("{{ ", " }}"), ("{% ", "%}"), ("${", "}"), ("<<", ">>"), ("«", "»"), ("[[", "]]"), ("&lt;", "&gt;"))), f"<{LONG} here>"],
)
def test_slots_of_any_length_and_expression(text):
    assert residue.evidence(text)[0] == "slot"


@pytest.mark.parametrize("text", ["The sets {{1, 2}, {3}} and {{a, b}, {c}} are shown.", "{{ }} is empty.", "<% %> is empty.", "He wrote [insert of the\n\nnext paragraph] here.", "{{ open\n\nnext }} paragraph", "<<open\n\nnext>> paragraph", '{"a": {"b": {"c": 1}}}'])
def test_slots_end_in_their_paragraph(text):
    assert residue.evidence(text) is None


def test_furniture_is_judged_once_and_never_hides_evidence(spark):
    banner = "Please enable JavaScript for the menu."
    rows = [(i, "h", f"Own text {'ab'[i % 2]}.\n\n{banner}") for i in range(30)] + [(100, "h", "Error 404"), (101, "other", f"Text.\n{banner}"), (102, None, f"Text.\n{banner}"), (103, "h", None), (104, "h", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, host string, text string, lines string").drop("lines")
    assert sorted(r["id"] for r in residue.residue(df).collect()) == [*range(30), 100, 101, 102]
    assert residue.residue(df.limit(0)).count() == 0
    parts = {r["id"]: (r["text"], r["recurring"]) for r in residue.residual(df).collect()}
    assert parts[0] == ("Own text a.\n", banner) and parts[101] == (f"Text.\n{banner}", None) and parts[103] == (None, None)


def test_error_pages_of_one_host(spark):
    rows = [(i, "h", "404 Not Found" if i < 30 else f"The mills of {chr(97 + i % 26) * 3}{i} were sold.") for i in range(100)]
    assert sorted(r["id"] for r in residue.residue(spark.createDataFrame(rows, "id bigint, host string, text string")).collect()) == list(range(30))


def test_own_lines_beside_furniture_stay(spark):
    rows = [(i, "h", f"Visit number {chr(97 + i)} here\nfor the menu\n\nfoot") for i in range(20)] + [(50, "h", "foot\n\nfor the menu")]
    parts = {r["id"]: (r["text"], r["recurring"]) for r in residue.residual(spark.createDataFrame(rows, "id bigint, host string, text string")).collect()}
    assert parts[0] == ("Visit number a here\nfor the menu\n", "for the menu\nfoot") and parts[50] == ("", "foot\nfor the menu")


def test_made_up_filler():
    assert residue.evidence("Real text of the year.\n\nVelo mardit sora tempel. Sora velo quin mardit tempel velo. Quin sora mardit.")[0] == "filler"
    names = "Board: Anna Berg, Carl Dunn, Elsa Falk, Gus Holm, Ida Jung, Karl Lund, Mia Noor, Otto Palm"
    assert residue.evidence(names) is None and residue.evidence("Revenue 12 income 4 revenue 13 income 5 " * 9) is None


def test_recurrent_evidence_is_found(spark, tmp_path):
    texts = ["Error 404: the page you requested was not found.\nTry again later.", "Real text.\nPlease enable\nJavaScript to view this report.", "Lorem ipsum dolor.\nMenu"]
    rows = [(100 * k + i, "en", " Host", f"{t}\nOwn text {'ab'[i % 2]}." if k else t, 1) for k, t in enumerate(texts) for i in range(25)] + [(900, "en", "host", "Own text.\nMenu", 1), (901, "en", None, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    cases = sorted(r[0] for r in rows if r[0] < 900)
    for name in ("p8_found", "p8_evidence"):
        assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == cases
    assert sorted(r["doc_id"] for r in queries.p8_kept(spark, str(tmp_path)).collect()) == [900, 901]
