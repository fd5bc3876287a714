"""Operators over documents against their plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from corrobora.llm import decontamination, hashing, lines, near_duplicates, substrings

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Fresh texts, exact and near copies of several strengths, shared passages, a long text, white space, nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(WORDS)[:4] for _ in range(rng.randint(1, 3)))
    text = lambda k: "\n".join(" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(k))
    passage, line, rows = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(12)), []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            t = rng.choice(rows)[1]
        elif rows and kind < 0.5:
            w = (rng.choice(rows)[1] or "one two").split(" ")
            for _ in range(rng.choice([1, 2, max(1, len(w) // 12)])):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.6:
            t = f"{text(2)} {passage} {text(1)}\n{line}"
        else:
            t = text(rng.randint(1, 6))
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, " \t\n\x0b"), (1003, "Word"), (1004, "wORD"), (1005, "same " * 200), (1006, "same " * 90), (1007, text(900)), (1008, "ein Wört\u2003größer 😀 " * 9)]
    return rows


def test_hashes_are_those_of_the_words():
    import pyarrow as pa
    import re
    texts = [t for _, t in corpus(1)] + ["É\u00a0É", "\x00a\x7fb", "[`{"]
    for pattern, inside in ((brute.SPACED, hashing.SPACED), (brute.ALNUM, hashing.ALNUM), (r"[^\n]+", hashing.LINES)):
        seen: dict = {}
        for low, high, pieces in hashing.slices(pa.array(texts), inside, limit=300):
            for d in range(low, high):
                words = re.findall(pattern, (texts[d] or "").translate(brute.LOWER))
                found = pieces.hashes[pieces.first[d - low]:pieces.first[d - low + 1]]
                assert len(words) == len(found)
                for w, h in zip(words, found):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, docs_frame, seed):
    rows = corpus(seed)
    found = {r.id: (r.n_shingles, r.component) for r in near_duplicates.components(docs_frame(rows)).collect()}
    assert found == brute.near_duplicates(rows) and len(set(c for _, c in found.values())) < len(rows)


def test_near_duplicates_of_odd_rows(spark, docs_frame):
    out = near_duplicates.components(docs_frame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, None)])).collect()
    assert sorted((r.id is None, r.id, r.component) for r in out if r.id is not None) == [(False, 5, 5), (False, 5, 5), (False, 7, 5), (False, 8, 8)]
    assert [r.component for r in out if r.id is None] == [None]
    assert near_duplicates.components(docs_frame([])).collect() == []


def test_near_copies_of_near_copies_meet(spark, docs_frame):
    """A chain of slow changes is one group although its ends have little in common; a group of texts at about 0.7 is none."""
    rng, words, rows = random.Random(4), [f"w{i}" for i in range(120)], []
    for i in range(40):
        words = list(words)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(words)))
    base = [f"b{i}" for i in range(120)]
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(120), 4):
            w[at] = f"x{i}-{at}"
        rows.append((100 + i, " ".join(w)))
    assert {r.id: (r.n_shingles, r.component) for r in near_duplicates.components(docs_frame(rows)).collect()} == brute.near_duplicates(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, docs_frame, seed):
    rows = corpus(seed)
    frame = docs_frame(rows)
    out = lines.deduplicated(frame)
    assert out.columns == [*frame.columns, "removed_"]
    want = brute.line_dedup(rows)
    for r in out.collect():
        n, kept_in = (r.removed_.n, list(r.removed_.kept_in)) if r.removed_ else (0, [])
        text = None if dict(rows)[r.doc_id] is None else want[r.doc_id][3]
        assert (n, kept_in, r.text) == (want[r.doc_id][1], want[r.doc_id][2], text), r.doc_id
        assert r.removed == "x" and r.lang == "en"


def test_lines_with_one_changed_character(spark, tmp_path):
    """Lines of 40 to 90 different characters with one changed anywhere, shorter ones with one changed at an end, go in the query; others stay."""
    from corrobora.llm import queries
    rng, rows, copies = random.Random(7), [], set()
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    for i, n in enumerate([*range(40, 91, 2), *range(30, 40)]):
        line = rng.sample(letters, n)
        changed = list(line)
        changed[rng.randrange(n) if n >= 40 else rng.choice([0, n - 1])] = rng.choice("0123456789")
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(changed))]
        copies.add(2 * i + 1)
    rows += [(500, "".join(rng.sample(letters, 60)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.n_removed for r in queries.op1(spark, str(tmp_path)).collect()}
    want = brute.line_dedup(rows, 4)
    assert out == {i: x[1] for i, x in want.items()} and {i for i, n in out.items() if n} == copies


def test_lines_of_odd_rows(spark, docs_frame):
    line = "a line that is long enough to be compared"
    out = lines.deduplicated(docs_frame([(2, f"{line}\n\n{line.upper()}\n  \nlast"), (1, line), (None, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, line), (0, line), (1, line), (2, "\n  \nlast")]
    assert lines.deduplicated(docs_frame([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings(spark, docs_frame, seed):
    rows = corpus(seed)
    want = brute.substring_dedup(rows)
    got = {r.doc_id: (r.rest.n_words, r.rest.n_removed, r.rest.text) for r in substrings.without_repeats(docs_frame(rows)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_substrings_of_odd_rows(spark, docs_frame):
    text = " ".join(f"w{i}" for i in range(50))
    out = substrings.without_repeats(docs_frame([(1, text), (1, text), (None, text), (2, " ".join(f"w{i}" for i in range(5, 45))), (3, "w1 " * 36)])).collect()
    assert sorted((r.doc_id or 0, r.rest.n_removed, r.rest.n_repeats) for r in out) == [(0, 0, 0), (1, 50, 1), (1, 50, 1), (2, 40, 1), (3, 36, 1)]
    assert substrings.without_repeats(docs_frame([])).collect() == []


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, "..."), (10, "one two three four five six seven eight nine ten"), (11, "Größe a1")]


def contaminated(spark, frame, items):
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    return [(r.id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(frame, item_frame).collect()]


def test_contamination(spark, docs_frame):
    rows = [(1, "zero ONE, two three-four five six seven eight nine ten! eleven"), (2, "a short item; another Short Item short"), (3, None), (4, "one two three four five six seven eight nine"),
            (5, "two three four five six seven eight nine ten eleven twelve one two three four five six seven eight nine ten"), (6, "größe a1 Größe A1"), (7, ""), *[(i + 20, t) for i, t in corpus(3)]]
    want = brute.contamination(rows, ITEMS)
    assert sorted(contaminated(spark, docs_frame(rows), ITEMS)) == sorted((i, *x) for i, x in want.items())
    assert sum(x[1] > 0 for x in want.values()) >= 3


def test_contamination_in_batches_and_odd_rows(spark, docs_frame, monkeypatch):
    rows = corpus(2)
    items = [(i, " ".join(t.split()[3:3 + n])) for n, (i, t) in zip((4, 10, 11, 25, 60, 9, 300), [r for r in rows if r[1] and len(r[1].split()) > 20])]
    want = sorted((i, *x) for i, x in brute.contamination(rows, items).items())
    assert sorted(contaminated(spark, docs_frame(rows), items)) == want
    monkeypatch.setattr(decontamination, "BATCH_WORDS", 40)
    assert sorted(contaminated(spark, docs_frame(rows), items)) == want
    assert contaminated(spark, docs_frame([]), items) == [] and {x[2] for x in contaminated(spark, docs_frame(rows), [])} == {0}


def test_proximity_matches(spark, docs_frame):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    rows = docs_frame([(1, "two one three four six five seven eight nine ten twelve eleven"), (2, "one " + "x " * 40 + "two three"), (3, "nothing of it")])
    assert decontamination.matches(rows, items).collect() == []
    assert {(r.doc, r.item) for r in decontamination.matches(rows, items, slop=4).collect()} == {(1, 1)}


@pytest.mark.parametrize("frequent,piece,block", [(64, 512, 512), (8, 16, 8)])
def test_lines_in_large_groups(spark, docs_frame, monkeypatch, frequent, piece, block):
    """Families of near-copies, some just above and some just below the limit: marked keys, cut pieces and blocks lose no link."""
    from corrobora.llm import links
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    monkeypatch.setattr(lines, "PIECE", piece)
    monkeypatch.setattr(lines, "cross_links", lambda *a, **b: links.cross_links(*a, block=block, **b))
    rng, rows = random.Random(11), []
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    for family in range(3):
        base = rng.sample(letters, 120)
        for i in range(130):
            own = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
                own[at] = rng.choice(letters)
            rows.append((1000 * family + i, "".join(own)))
    rows += [(9000 + i, "".join(rng.sample(letters, 90))) for i in range(60)]
    want = brute.line_dedup(rows)
    got = {r.doc_id: (r.removed_.n if r.removed_ else 0) for r in lines.deduplicated(docs_frame(rows)).collect()}
    assert got == {i: x[1] for i, x in want.items()} and 100 < sum(got.values()) < len(rows)


def test_sketches_refuse_pairs_but_never_links(monkeypatch):
    from corrobora.llm import links
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for n in (1, 5, 60, 250)]
    sets = []
    for values in base:
        for share in (0, 0.02, 0.1, 0.11, 0.12, 0.2, 0.3, 0.5):
            changed = values.copy()
            at = rng.permutation(len(values))[:round(share * len(values))]
            changed[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64) * np.uint64(2)
            sets.append(np.unique(changed))
    want = np.array([[links.alike(a, b, 80) for b in sets] for a in sets])
    counted = []
    alike = links.alike
    monkeypatch.setattr(links, "alike", lambda *pair: counted.append(1) or alike(*pair))
    assert (links.exact_links(sets, sets, 80) == want).all() and want.sum() <= len(counted) < len(sets) ** 2 / 4
    apart = rng.random(want.shape) < 0.5
    assert (links.exact_links(sets, sets, 80, apart) == (want & apart)).all()
    monkeypatch.setattr(links, "ONE_BY_ONE", 0)
    assert (links.exact_links(sets, sets, 80) == want).all() and (links.exact_links(sets, sets, 80, apart) == (want & apart)).all()


def test_pairs_of_lines_meet_their_texts_only_if_sketches_allow_a_link():
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words[:20] + ["x" + w for w in words[20:]]), "short", "line\twith é and more"]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(texts)]), pa.array([[int(i) for i in next(iter(hashing.slices(pa.array(["\n".join(texts)]), hashing.LINES)))[2].hashes.view(np.int64)]])], ["text", "ids"])
    held = pa.Table.from_batches(lines._wanted_lines(4)(iter([batch]))).to_pylist()
    assert {r["bytes"].decode() for r in held} == set(texts)
    assert all(r["size"] == len({r["bytes"].decode()[i:i + 4] for i in range(max(1, len(r["bytes"].decode()) - 3))}) for r in held)
    pairs = [(a, b) for a in held for b in held]
    rows = pa.RecordBatch.from_pydict({"u": [a["id"] for a, _ in pairs], "v": [b["id"] for _, b in pairs], "su": [a["size"] for a, _ in pairs], "sv": [b["size"] for _, b in pairs],
                                       "ku": [a["sketch"] for a, _ in pairs], "kv": [b["sketch"] for _, b in pairs]})
    kept = {(r["u"], r["v"]) for b in lines._hopeful(80)(iter([rows])) for r in b.to_pylist()}
    name = {r["id"]: texts.index(r["bytes"].decode()) for r in held}
    assert {(name[u], name[v]) for u, v in kept} == {(0, 1), (1, 0)} | {(i, i) for i in range(len(texts))}


def test_wanted_lines_are_found_where_the_texts_stand(spark):
    """Places of lines come to the texts as bits of a set: every wanted line is found, and few others."""
    texts = spark.createDataFrame([(d, "\n".join(f"line {i} of document {d}" for i in range(50))) for d in range(200)] + [(7, None)], "doc long, text string")
    found = texts.select("doc", "text").mapInArrow(lines._occurrences, "doc long, line int, id long")
    places = lines.kept(found.where("line % 10 = 3 AND doc < 100").select("id", "doc"), "places")
    got = lines._lines_at(texts, places, 4, {"bytes": "binary"})
    held = {bytes(r.bytes).decode() for r in got.collect()}
    assert {f"line {i} of document {d}" for i in range(3, 50, 10) for d in range(100)} <= held and len(held) < 600


def test_blocks_of_lines_meet_their_contents_only_if_sketches_allow_a_link(spark, monkeypatch):
    from corrobora.llm import links
    rng, sets = np.random.default_rng(9), {}
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    for i in range(40):      # near copies of one another in two components, and others that share a third of their elements
        own = base.copy()
        own[rng.permutation(60)[:1 if i < 8 else 40]] = rng.integers(0, 2**63, 1 if i < 8 else 40, dtype=np.uint64) * np.uint64(2)
        sets[i] = np.unique(own)
    want = {(a, b) for a in sets for b in sets if a < b and a % 2 != b % 2 and links.alike(sets[a], sets[b], 80)}
    rows = spark.createDataFrame([(1, i, i % 2, 0) for i in sets], "key long, id long, component long, bits long")
    sketch = links.sketches(np.concatenate(list(sets.values())), np.cumsum([0, *map(len, sets.values())]))
    marks = spark.createDataFrame([(i, len(s), sketch[i].tobytes()) for i, s in sets.items()], "id long, size int, sketch binary")
    asked: list[int] = []

    def fetch(ids):
        asked.extend(r.id for r in ids.distinct().collect())
        return spark.createDataFrame([(i, [int(x) for x in (sets[i] >> np.uint64(1)).astype(np.int64)]) for i in sets], "id long, content array<long>")

    tried: list[tuple[int, int]] = []

    def verify(pairs):
        tried.extend((r.u, r.v) for r in pairs.collect())
        return pairs.where("u < 8 AND v < 8")

    contents = (fetch, "array<long>", links.list_sets)
    few = links.cross_links(rows, contents, 80, different=15, marks=marks, verify=verify)
    assert {(r.u, r.v) for r in few.collect()} == want and set(tried) == want and not asked
    # more possible pairs than rows can hold meet their contents in blocks; one link joins the two components
    monkeypatch.setattr(links, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(links, "BLOCK", 3)
    many = {(min(r), max(r)) for r in links.cross_links(rows, contents, 80, different=15, marks=marks, verify=lambda pairs: pairs).select("u", "v").collect()}
    assert many and many <= want and sorted(set(asked)) == list(range(8))
