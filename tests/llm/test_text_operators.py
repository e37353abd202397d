import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from locusframe.llm import bpe, decontam, ngram_join, queries, rollup, sharding
from locusframe.llm.components import connected_components
from locusframe.llm.text import shingle_set, utf8, words

from .cases import SCHEMA, empty_frame, odd_documents, odd_frame, prose

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, P.PATTERN)


# Words and shingles


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_agree_with_the_pattern():
    texts = [t for _, t, *_ in odd_documents()] + ["a" * 3_000_000 + " b", " " * 5000 + "End", "A\vb\fc\r\nd"]
    data, offsets = utf8(pa.array(texts))
    hashes, first, last, at = words(data, offsets)
    for i, text in enumerate(texts):
        found = [bytes(data[a:b]).decode() for a, b in zip(first[at[i] : at[i + 1]], last[at[i] : at[i + 1]])]
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] == _plain_words(text)
    by_word = defaultdict(set)
    for h, a, b in zip(hashes, first, last):
        by_word[re.sub("[A-Z]", lambda m: m[0].lower(), bytes(data[a:b]).decode())].add(int(h))
    assert all(len(x) == 1 for x in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té", max_size=40), max_size=6))
def test_shingle_sets_count_distinct_runs(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    hashes, _, _, at = words(data, offsets)
    for i, text in enumerate(texts):
        w = _plain_words(text)
        want = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(shingle_set(hashes[at[i] : at[i + 1]], 5)) == len(want)


# Byte-level BPE


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_librarys(codec, library, text):
    assert codec.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_segment_tree_merges_leftmost_smallest(ranks, piece):
    """Against merging by rescanning the whole sequence."""
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == 1 << 40:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [ranks[p] for p in parts] if piece not in ranks else [ranks[piece]]
    assert bpe.merge_bytes(piece, ranks) == want


def test_bpe_long_matches(codec, library):
    for text in ("a" * 50_000, "ab" * 700 + "%$#" * 300, prose(9, 30_000) * 9, "<|endoftext|>"):
        assert codec.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_bpe_documents(spark, library):
    rows = bpe.encode_documents(odd_frame(spark), RANKS, P.PATTERN, ids=True).collect()
    texts = [t or "" for _, t, *_ in odd_documents()]
    assert len(rows) == len(texts)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.token_ids)) for r in rows)
    want = Counter()
    for (i, *_), text in zip(odd_documents(), texts):
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids] += 1
    assert got == want
    assert bpe.encode_documents(empty_frame(spark), RANKS, P.PATTERN).count() == 0


# Sharding


def test_shards_match_the_mixture(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 7) END AS source")
    rows = sharding.interleave_shards(docs, 24).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total = Counter(r.source for r in rows)
    for x in by.values():
        for source, n in Counter(r.source for r in x).items():
            assert abs(n - total[source] / 24) <= 2
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave_shards(docs.repartition(7), 24).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def _plain_shards(rows, shards=24):
    """(id, shard, slot) by the definition, for rows (id, text, source)."""
    by = defaultdict(list)
    for i, t, s in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        by[s].append((hashlib.md5(f"mix-1:{i if i is not None else f':{size}:{crc}'}".encode()).hexdigest(), -1 if i is None else i, size, crc, i))
    order = sorted(((2 * k + 1) / (2 * len(x)), *row) for x in by.values() for k, row in enumerate(sorted(x, key=lambda r: r[:4])))
    n, out, seen = len(order), [], Counter()
    for at, (*_, i) in enumerate(order):
        shard = at * shards // n
        out.append((i, shard, seen[shard]))
        seen[shard] += 1
    return Counter(out)


@pytest.mark.parametrize("heavy", [2_000, 40])
def test_shards_against_the_definition_with_sources_of_one_row(spark, monkeypatch, heavy):
    monkeypatch.setattr(sharding, "HEAVY_ROWS", heavy)
    rows = [(i, f"t{i}", f"host{i}") for i in range(900)] + [(1000 + i, f"u{i}", "hot") for i in range(301)] + [(None, f"v{i % 60}", "hot") for i in range(200)] + [(None, None, None)] * 3 + [(7, "t7", "host7")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert Counter((r.doc_id, r.shard, r.slot) for r in sharding.interleave_shards(docs).collect()) == _plain_shards(rows)


def test_no_bucket_holds_one_fraction(spark, monkeypatch):
    """Half of all rows are alone in their source and share the fraction; no bucket holds more than a few hundredths."""
    monkeypatch.setattr(sharding, "HEAVY_ROWS", 100)
    ranked = spark.range(6000).selectExpr("id", "'s' AS stratum", "1L AS size", "2L AS crc", "md5(cast(id AS string)) AS h", "if(id % 2 = 0, 0.5D, id / 6000D) AS frac").selectExpr("*", "cast(floor(frac * 64) AS int) AS fb")
    got = sharding._cut_fractions(ranked, 6000)
    order = [(r.frac, r.h) for r in got.orderBy(*sharding.BUCKET, "frac", "h").collect()]
    assert order == sorted(order) and len(order) == 6000
    assert max(r["count"] for r in got.groupBy(*sharding.BUCKET).count().collect()) < 200


def test_shards_of_odd_rows(spark):
    rows = sharding.interleave_shards(odd_frame(spark), 4).collect()
    want = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in odd_documents())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sharding.interleave_shards(empty_frame(spark)).count() == 0


# Components and the n-gram join


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (202, 202)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = _components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 202}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def _brute_join(rows, k=5, percent=80):
    sets = []
    for text in rows:
        w = _plain_words(text)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], _components(range(len(sets)), links)


def test_ngram_join_against_brute_force(spark):
    import random

    r = random.Random(5)
    texts = []
    for g in range(12):  # copies, near copies with one to many changes, and a passage that many share
        base = prose(100 + g, 60 + 10 * g).split()
        for _ in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.randrange(7)):
                w[r.randrange(len(w))] = f"changed{r.randrange(9)}"
            texts.append(" ".join(w))
    shared = prose(77, 40)
    texts += [shared + " " + prose(300 + i, 12) for i in range(15)] + ["", "  ", "One", "one", "a b c d", "A b C d", "a b c d e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes, parts = _brute_join(texts)
    got = {x.doc_id: x for x in ngram_join.jaccard_components(rows).collect()}
    assert {i: got[i].n_shingles for i in got} == dict(enumerate(sizes))
    assert {i: got[i].component_id for i in got} == parts


def test_ngram_join_of_odd_rows(spark):
    got = ngram_join.jaccard_components(odd_frame(spark)).collect()
    sizes, _ = _brute_join([t for _, t, *_ in odd_documents()])
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, n) for (i, *_), n in zip(odd_documents(), sizes))
    part = {r.doc_id: r.component_id for r in got}
    assert part[1] == part[2] == part[3] == 1 and part[8] == part[9] == 8 and part[5] == 5 and part[6] == 6 and part[7] == 7
    assert ngram_join.jaccard_components(empty_frame(spark)).count() == 0


def test_ngram_join_links_rows_without_ids(spark):
    w = [prose(500, 60).split()]
    for at in (3, 20, 40, 55):  # neighbours link; the ends of the chain reach each other through rows without ids only
        w.append([*w[-1][:at], f"changed{at}", *w[-1][at + 1 :]])
    texts = [" ".join(x) for x in w]
    sizes, parts = _brute_join(texts)
    assert len(set(parts.values())) == 1
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (None, prose(501, 60)), (None, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(1, 1): 1, (None, 1): 4, (2, 1): 1, (None, None): 2})


def test_one_of_each_group_stays(spark):
    kept = sorted(r.doc_id or -1 for r in ngram_join.keep_one_per_component(odd_frame(spark)).collect())
    assert kept == [-1, 1, 4, 5, 6, 7, 8, 10, 11, 12, 13]


# Decontamination


def _leak_frames(spark):
    item = prose(50, 30)
    half = item.split()
    docs = [(1, "start " + item + " end"), (2, " ".join(half[15:]) + " and " + " ".join(half[:15])), (3, prose(51, 200)), (4, " ".join(half[:10])), (5, None), (6, ""), (7, (item + " ") * 300), (8, item.upper().replace(" ", ", "))]
    bench = [(1, item), (2, "of the"), (3, None), (4, prose(52, 6))]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")


def test_leaks_are_found_whole_and_reordered(spark):
    docs, bench = _leak_frames(spark)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1), (8, 1)}
    assert got[1, 1].coverage == 1 and got[1, 1].n_tiles == 1 and got[1, 1].tiles[0].doc_start == 1
    assert got[2, 1].coverage == 1 and got[2, 1].n_tiles == 2
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.find_leaks(empty_frame(spark), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(odd_frame(spark), bench).count() == len(odd_documents())


def test_slices_give_the_same_leaks(spark, monkeypatch):
    docs, bench = _leak_frames(spark)
    whole = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "SLICE_WORDS", 8)
    assert {(r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(docs, bench).collect()} == whole


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40), st.integers(2, 4))
def test_tiling_against_the_definition(item, text, least):
    """Longest free common stretches first: rounds of plain search give the same covered tokens."""
    a, b = np.array(item, np.uint64), np.array(text, np.uint64)
    tiles = decontam.tile(a, b, least)
    used_a, used_b = np.zeros(len(a), int), np.zeros(len(b), int)
    for i, j, n in tiles:
        assert n >= least and (a[i : i + n] == b[j : j + n]).all()
        used_a[i : i + n] += 1
        used_b[j : j + n] += 1
    assert used_a.max(initial=0) <= 1 and used_b.max(initial=0) <= 1
    for i in range(len(a) - least + 1):  # nothing long enough is left
        for j in range(len(b) - least + 1):
            assert used_a[i : i + least].any() or used_b[j : j + least].any() or (a[i : i + least] != b[j : j + least]).any()
    longest = max((n for n in range(least, min(len(a), len(b)) + 1) if any((a[i : i + n] == b[j : j + n]).all() for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))), default=0)
    assert max((n for *_, n in tiles), default=0) == longest


def _plain_tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling as defined: all longest free common stretches by search, the first of them marked, and again."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return tiles
        n, i, j = best
        tiles.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=22), st.lists(st.integers(0, 2), max_size=30), st.integers(2, 5), st.integers(1, 40))
def test_tiles_are_those_of_the_definition(item, text, least, pairs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontam, "PAIRS", pairs)
        assert sorted(decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), least)) == sorted(_plain_tiles(item, text, least))


def test_leaks_against_brute_force(spark):
    import random

    r = random.Random(12)
    items = [(i, prose(600 + i, 12 + i)) for i in range(8)] + [(3, prose(620, 9)), (20, "the of the of the of the of"), (21, "to be"), (None, prose(621, 11))]
    docs = []
    for n in range(40):
        parts = []
        for _ in range(r.randrange(4)):
            w = r.choice(items)[1].split()
            cut = r.randrange(len(w) + 1)
            parts += r.choice([w, w[cut:] + w[:cut], w[: max(1, len(w) * 6 // 10)], w[::2]])
            parts += prose(r.randrange(10**6), r.randrange(6)).split()
        docs.append((n % 37, r.choice([" ", ", ", "\n- "]).join(parts)))
    docs += [docs[5], (99, None), (99, ""), (None, items[2][1])]
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = Counter()
    for d, text in docs:
        best = {}
        for i, it in items:
            a = tokens(it)
            tiles = _plain_tiles(a, tokens(text), 5)
            covered = sum(n for *_, n in tiles)
            if covered and covered >= 0.5 * len(a):
                best[i] = max(best.get(i, (0, 0, 0)), (covered, len(a), -len(tiles)))
        want.update((d, i, n, covered, -k) for i, (covered, n, k) in best.items())
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find_leaks(frame.selectExpr("*", "1 AS item_words", "2 AS coverage", "3 AS _rank"), bench).collect()
    assert Counter((x.doc_id, x.item_id, x.item_words, x.covered_words, x.n_tiles) for x in got) == want and len(want) > 20
    leaking = Counter(d for d, _ in docs)
    stay = Counter(x.doc_id for x in decontam.drop_leaks(frame, bench).collect())
    assert set(leaking) - set(stay) <= {d for d, *_ in want} and sum(stay.values()) == sum(1 for d, t in docs if not any(2 * sum(n for *_, n in _plain_tiles(tokens(it), tokens(t), 5)) >= len(tokens(it)) and len(tokens(it)) >= 5 for _, it in items))


def test_repeated_tokens_do_not_make_tiling_slow():
    import time

    one, period = np.ones(4000, np.uint64), np.tile(np.arange(7, dtype=np.uint64), 300)
    began = time.process_time()
    assert decontam.tile(one, np.ones(16_000, np.uint64), 5) == [(0, 0, 4000)]
    assert sum(n for *_, n in decontam.tile(period, np.tile(period, 4), 5)) == len(period)
    assert time.process_time() - began < 3


def test_slices_hold_no_more_tokens_than_they_may(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_WORDS", 40)
    bench = spark.createDataFrame([(i, "a b c d e f g h i j " * (1 + i % 3)) for i in range(30)] + [(50, f"{i} " * 25) for i in range(4)], "item_id bigint, text string")
    slices = list(decontam._slices(bench, "item_id", "text", 5))
    assert sum(len(x.ids) for x in slices) == 34 and all(sum(map(len, x.tokens)) <= 40 or len(set(x.ids)) == 1 for x in slices)
    assert sum(50 in x.ids for x in slices) == 1
    assert [x.ids for x in decontam._slices(bench.limit(0), "item_id", "text", 5)] in ([], [[]])


# Token rollups


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    make = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint")
    first = make([("a", "en", "v1", 1, 10, 100), ("a", "en", "v1", 1, 5, 50), (None, None, "v1", 1, 7, 70)])
    assert r.apply("b1", first) and not r.apply("b1", first)
    assert r.apply("b2", make([("a", "en", "v1", -1, 5, 50), ("a", "en", "v1", -1, 10, 100), ("a", "en", "v1", 1, 12, 100)]))
    want = {("a", "en", "v1", 1, 12, 100), (None, None, "v1", 1, 7, 70)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and r.batches() == ["b1", "b2"]
    assert not r.apply("b2", first) and r.apply("b3", make([(None, None, "v1", -1, 7, 70)]))
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v1", 1, 12, 100)}
    assert r.apply("empty", make([]))
    with pytest.raises(ValueError):
        r.apply("a/b", first)
    with pytest.raises(Exception):
        r.apply("bad", make([("a", "en", "v1", None, 1, 1)]))
    assert "bad" not in r.batches()


def test_interrupted_batch_is_written_again(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    half = tmp_path / "r/delta/b1"
    half.mkdir(parents=True)
    (half / "part-junk.parquet").write_bytes(b"junk")
    assert r.batches() == []
    assert r.apply("b1", spark.createDataFrame([("a", "en", "v", 1, 1, 1)], "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint"))
    assert r.totals().count() == 1


@pytest.mark.parametrize("name", ["..", ".", "...", "_x", "-x", ".hidden", "", "a/b", "a b", "é"])
def test_names_that_are_no_folders_of_their_own_are_refused(spark, tmp_path, name):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("a", "en", "v", 1, 1, 1)], "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint")
    assert r.apply("b1", one)
    with pytest.raises(ValueError):
        r.apply(name, one)
    assert r.batches() == ["b1"] and r.totals().count() == 1


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path, monkeypatch):
    r, other = (rollup.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    row = lambda n: spark.createDataFrame([("a", "en", "v", 1, n, 1)], "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint")
    asked = []

    def late(batch, known=rollup.TokenRollup.committed):
        asked.append(known(r, batch))
        if len(asked) == 1:
            assert other.apply("b1", row(7))  # commits after the first has looked
        return asked[-1]

    monkeypatch.setattr(r, "committed", late)
    assert not r.apply("b1", row(5))
    assert [x.n_tokens for x in other.totals().collect()] == [7]


def test_readers_outlive_a_compaction(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    row = lambda s: spark.createDataFrame([(s, "en", "v", 1, 1, 1)], "source string, lang string, tokenizer string, sign bigint, tokens bigint, bytes bigint")
    r.compact()
    assert r.totals().count() == 0
    for i in range(4):
        r.apply(f"b{i}", row(f"s{i}"))
        began = r.totals()
        r.compact()
        assert began.count() == r.totals().count() == i + 1
        assert not r.apply(f"b{i}", row("again"))
    assert r.batches() == ["b0", "b1", "b2", "b3"] and len(r._committed("delta")) <= 2 and len(r._committed("base")) <= 2


def test_token_totals_are_the_librarys(spark, library, tmp_path):
    odd_frame(spark, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(x) for x in queries.op4_token_counts(spark, str(tmp_path)).collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for _, t, lang, source, _ in odd_documents():
        t = t or ""
        for name, n in ((rollup.BPE, len(library.encode_ordinary(t))), (rollup.WORD, len(_plain_words(t)))):
            for i, x in enumerate((1, n, len(t.encode()))):
                want[source, lang, name][i] += x
    assert got == {(*key, *sums) for key, sums in want.items()}
    clashing = rollup.token_totals(odd_frame(spark).selectExpr("*", "1 AS n_tokens", "2 AS words", "3 AS bytes"), rollup.TokenRollup.temporary(spark), RANKS, P.PATTERN)
    assert {tuple(x) for x in clashing.collect()} == got
    assert rollup.token_totals(empty_frame(spark), rollup.TokenRollup.temporary(spark), RANKS, P.PATTERN).count() == 0


def test_rollup_of_odd_rows(spark):
    got = {tuple(x)[:5] for x in rollup.corpus_totals(odd_frame(spark), rollup.TokenRollup.temporary(spark)).filter("tokenizer = 'words-1'").collect()}
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, source, _ in odd_documents():
        if len((t or "").split()) >= 20:
            want[source, lang][0] += 1
            want[source, lang][1] += len(re.sub(r"[#$%&*!|]+", " ", t).split())
    assert got == {(s, l, "words-1", n, w) for (s, l), (n, w) in want.items()}


def test_corpus_counts_cover_every_whole_text(spark, tmp_path):
    odd_frame(spark, extra=False).unionByName(spark.createDataFrame([(90, "short $$ only", "xx", "z", 13), (91, "stone $$ river " * 20, "xx", "y", 300)], SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(x) for x in queries.rollup_words(spark, str(tmp_path)).collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for x in spark.read.parquet(str(tmp_path / "documents.parquet")).collect():
        t = x.text or ""
        for name, pattern in (("words-1", rollup.WORDS), ("marks-1", rollup.MARKS)):
            for i, n in enumerate((1, len(re.findall(pattern, t)), len(t.encode()))):
                want[x.source, x.lang, name][i] += n
    assert got == {(*key, *sums) for key, sums in want.items()}
