"""Phrase collocations, bound-certified packing and conversation repair, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curbside.llm import bound_packing, collocations, turn_repair
from curbside.llm.bound_packing import best_fit_decreasing, certificate, cuts, lower_bound, packed
from curbside.llm.bytecache import ByteTokenizer, packed_ids
from tests.llm.frames import documents, odd_rows, prose

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).cache()


# 11. collocations


def brute_phrases(rows, top=2000):
    found = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        scored = []
        for g, a in f.items():
            if len(g) < 2 or a < 10:
                continue
            longer = [h for h in f if len(h) == 3 and f[h] >= 10 and g in (h[:2], h[1:])] if len(g) == 2 else []
            if any(100 * f[h] >= 50 * a for h in longer):
                continue
            scores = [(1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(scores)
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrases(df, **options):
    got = collocations.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def few_words(seed, n):
    pick = random.Random(seed)
    words = ["the", "The", "red", "Fox", "ÀB", "àb", "日本", "\x1c", "a.b", "c,", "d\n", "\te"]
    return " ".join(pick.choices(words, k=n))


def test_phrases_equal_brute_force(spark):
    boiler = "this long notice is repeated in each of the documents without any change"
    rows = [(i, few_words(i, 120), ("en", None, "de")[i % 3], "s") for i in range(30)]
    rows += [(100 + i, f"{boiler}. {prose(i, 8)}", "en", "s") for i in range(14)]
    assert phrases(documents(spark, rows)) == brute_phrases(rows)
    assert phrases(documents(spark, rows), top=3) == brute_phrases(rows, 3)


def test_phrases_of_odd_rows_and_none(spark, odd):
    assert phrases(odd) == brute_phrases(odd_rows())
    assert phrases(odd.limit(0)) == []


def test_small_blocks_carry_words_over(spark, monkeypatch):
    rows = [(i, few_words(i, 150) + " ", "en", "s") for i in range(8)] + [(9, "x y z " * 400, "en", "s")]
    whole = [w for block in collocations.split_text(rows[0][1]) for w in block]
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 7)
    small = [w for block in collocations.split_text(rows[0][1]) for w in block]
    squeeze = lambda ws: [w for w, _ in itertools.groupby(ws)] if b"" in ws else ws
    assert squeeze(small) == squeeze(whole)
    monkeypatch.undo()
    # The limits of a task are read in the task, so the block is cut there by hand.
    counted = Counter()
    held: list[bytes] = []
    for _, text, *_ in rows:
        for words in collocations.split_text(text):
            held += words
            while len(held) > 50:
                block, held = held[:50], held[48:]
                for codes, n, table in collocations.aggregated(block):
                    names = table.to_pylist()
                    for *gram, c in zip(*codes, n.tolist(), strict=True):
                        counted[b" ".join(names[g] for g in gram)] += c
    for codes, n, table in collocations.aggregated([*held, b"", b""]):
        names = table.to_pylist()
        for *gram, c in zip(*codes, n.tolist(), strict=True):
            counted[b" ".join(names[g] for g in gram)] += c
    expected = Counter()
    for _, text, *_ in rows:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", text.encode().lower()):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            for k in (1, 2, 3):
                expected.update(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    assert counted == expected


def block_counts(rows, limit):
    counted = defaultdict(Counter)
    texts = ((lang or "und", text) for _, text, lang, *_ in rows)
    for lang, block in collocations.blocks(texts, limit):
        for codes, n, table in collocations.aggregated(block):
            names = table.to_pylist()
            for *gram, c in zip(*codes, n.tolist(), strict=True):
                counted[lang][b" ".join(names[g] for g in gram)] += c
    return counted


@pytest.mark.parametrize("limit", [1, 5, 60, 10**6])
@pytest.mark.parametrize("size", [7, 1 << 20])
def test_full_blocks_count_the_last_words_of_pieces(monkeypatch, limit, size):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    langs = ("en", None, "de")
    rows = [(i, few_words(i, 40 + i) + " ." * (i % 2), langs[i % 3], "s") for i in range(12)]
    rows += [(20 + i, end, langs[i % 3], "s") for i, end in enumerate(["a bc def ", "abcdefg\t", "abcdefg \t", " ", "z"])]
    rows += [(30, "       a       b c .", "en", "s"), (31, None, "en", "s"), (32, "x y z " * 40, "de", "s")]
    expected = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w.encode() for w in re.split(r"[ \t]+", piece) if w]
            for k in (1, 2, 3):
                for at in range(len(words) - k + 1):
                    expected[lang or "und"][b" ".join(words[at : at + k])] += 1
    assert block_counts(rows, limit) == expected


def test_phrases_of_more_than_one_block_of_words(spark):
    rows = [(i, f"the end of part {i % 1500}. so it is", ("en", "de")[i % 2], "s") for i in range(120_000)]
    assert 8 * len(rows) < collocations.BLOCK_WORDS < 11 * len(rows)
    assert phrases(documents(spark, rows).coalesce(1)) == brute_phrases(rows)


def test_paths_are_maximal_and_hold_every_edge_once(spark):
    boiler = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(boiler), "en", "s") for i in range(12)]
    rows += [(50 + i, "w9 w10 w11 q", "en", "s") for i in range(11)]
    grams = collocations.frequent_grams(documents(spark, rows))
    paths = [tuple(r) for r in collocations.compacted(grams).collect()]
    edges = Counter(" ".join(p[1][i : i + 3]) for p in paths for i in range(len(p[1]) - 2))
    assert edges == Counter({g.gram: 1 for g in grams.filter("size = 3").collect()})
    # The pairs "w9 w10" and "w10 w11" have other edges too, so a path ends at each.
    assert sorted((len(p[1]), p[2]) for p in paths) == [(3, 11), (3, 23), (11, 12), (30, 12)]


# 12. packing


def test_byte_tokens_equal_the_library():
    known, whole = ByteTokenizer(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert known.by_rank and not ByteTokenizer(WORD_BPE).by_rank
    pick = random.Random(5)
    parts = [
        "a", "b ", "Won't", "'s", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日本", "\x85", "\xa0", " ",
        "1", "23", "!?", "...", "\x1c", "\x00", "<|endoftext|>", "\U0001f600", "’", "é", "　",
    ]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(4000)] + [prose(1, 300)]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert known.id_bytes(text) == packed_ids(ids), repr(text)


def test_other_tokenizer_files_give_their_own_ids():
    text, path = "Hello World again  and <|endoftext|>", WORD_BPE
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert ByteTokenizer(path).id_bytes(text) == packed_ids(ids)


def fewest(lengths, capacity):
    """Bins of a best packing, by trying all."""
    best = [len(lengths)]
    loads: list[int] = []

    def place(i):
        if len(loads) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(loads)
            return
        for b, load in enumerate(loads):
            if load + lengths[i] <= capacity:
                loads[b] += lengths[i]
                place(i + 1)
                loads[b] -= lengths[i]
        loads.append(lengths[i])
        place(i + 1)
        loads.pop()

    place(0)
    return best[0]


def test_no_bound_passes_the_fewest_bins():
    pick = random.Random(2)
    met = 0
    for _ in range(150):
        capacity = pick.choice([10, 17, 24])
        lengths = [pick.randint(1, capacity) for _ in range(pick.randint(1, 8))]
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        least = fewest(lengths, capacity)
        at, offset = best_fit_decreasing(np.array(lengths), capacity)
        assert bound <= least <= at.max() + 1
        met += bound == least
    assert met > 120
    assert lower_bound(np.zeros(11), 10) == 0


def check_sequences(rows, docs, capacity, end=0):
    """Each id in one piece, pieces cut as told, sequences gapless and not overfull."""
    whole = Tokenizer.from_file(BYTE_BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for doc, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, end]
        start = 0
        for piece, length in enumerate(cuts(len(ids), capacity)):
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            expected[doc].append((piece, start, length, crc))
            start += length
    found = {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for d, rs in pieces.items()}
    assert found == {d: sorted(x) for d, x in expected.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_cut_pieces():
    assert cuts(1, 8) == [1] and cuts(8, 8) == [8] and cuts(9, 8) == [1, 8] and cuts(24, 8) == [8, 8, 8]


@pytest.mark.parametrize("part", [7, 100_000])
def test_packing_of_odd_rows_and_prose(spark, odd, monkeypatch, part):
    monkeypatch.setattr(bound_packing, "PART_PIECES", part)
    rows = odd_rows() + [(2000 + i, prose(i, 5 + i * 3), "en", "s") for i in range(120)]
    df = documents(spark, rows).repartition(5)
    out = packed(df, BYTE_BPE)
    got = out.collect()
    n = check_sequences(got, [(r[0], r[1]) for r in rows], bound_packing.CAPACITY)
    seal = certificate(out)
    assert seal["sequences"] == n and seal["bound"] <= n
    if part > 7:
        assert n - seal["bound"] <= 1
    assert packed(odd.limit(0), BYTE_BPE).count() == 0


def test_exchanges_never_add_a_sequence(spark):
    pick = np.random.default_rng(4)
    rows = []
    for part in range(20):
        lengths = pick.integers(500, 1500, 60)
        at, offset = best_fit_decreasing(lengths, 2048)
        goes = bound_packing.released(at, lengths, 2048)
        rows += [
            (i, 0, 0, int(n), 0, int(a) + (part << 20), int(o), bool(g))
            for i, (n, a, o, g) in enumerate(zip(lengths, at, offset, goes, strict=True))
        ]
    df = spark.createDataFrame(rows, bound_packing.PIECE)
    before = len({r[5] for r in rows if r[7]})
    after = bound_packing.exchanged(df.filter("released"), 3, 1, 2048).collect()
    assert len(after) == sum(r[7] for r in rows)
    assert len({r.sequence_id for r in after}) < before


# 13. conversation repair


def brute_damage(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        kept[conv]  # every conversation stays
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return kept


def brute_repair(rows):
    """Faults and the cheapest edits of one conversation, by trying all edits with two insertions
    between rows at most."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        if not stripped:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    grammar = re.compile("(s?(ua)+)?")
    options = {(0, "", "", ())}
    prefix = re.compile("|".join([r"s?(ua)*u?", "s"]))
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = set()
        for cost, audit, roles, lines in options:
            for k in range(3):
                for more in itertools.product("ua", repeat=k):
                    names = {"u": "user", "a": "assistant"}
                    base = (cost + 2 * k, audit + "I" * k, roles + "".join(more), lines + tuple(f"{names[m]}:" for m in more))
                    late = 1 if fault == "truncated" else 0
                    new.add((base[0] + 3, base[1] + "D", base[2], base[3]))
                    if fault not in ("blank", "duplicate"):
                        if role:
                            new.add((base[0] + late, base[1] + "K", base[2] + role[0], (*base[3], f"{role}:{text}")))
                        for i in "ua":
                            new.add((base[0] + 2 + late, base[1] + "R", base[2] + i, (*base[3], f"{names[i]}:{text}")))
        new = {o for o in new if prefix.fullmatch(o[2])}
        # The cheapest and least of each end and start is enough to go on from.
        best = {}
        for o in sorted(new):
            best.setdefault((o[2][-1:], o[2] == ""), o)
        options = set(best.values())
    ends = []
    for cost, audit, roles, lines in options:
        for k in range(3):
            for more in itertools.product("ua", repeat=k):
                names = {"u": "user", "a": "assistant"}
                full = roles + "".join(more)
                if grammar.fullmatch(full):
                    ends.append((cost + 2 * k, audit + "I" * k, lines + tuple(f"{names[m]}:" for m in more)))
    cost, audit, lines = min(ends)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_edits_equal_all_edits_tried():
    """All sequences of four rows over the kinds of rows that edits tell apart."""
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c."), ("user", "d"), ("tool", "e."), ("user", "")]
    for picked in itertools.product(kinds, repeat=4):
        rows = [(i, role, f"{i}{text}" if text else "") for i, (role, text) in enumerate(picked)]
        c = turn_repair.Conversation(1)
        for turn, role, text in rows:
            c.take(turn, role, text, False)
        cost, _ = c.end()
        expected = brute_repair(rows)
        got = (c.gaps, *c.counts.values(), c.illegal, cost, "".join(c.audit), c.sha.hexdigest())
        assert got == expected, picked


CONVERSATION = "conv_id long, turn long, role string, text string, kind string, copies string, seen string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATION)


def odd_conversations():
    pick = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "no", "", " \n", "Really?", "end! ", None, "Yes."]
    rows = []
    for conv in range(40):
        rows += [(conv, t, pick.choice(roles), pick.choice(texts)) for t in range(pick.randint(1, 9))]
    rows += [
        (None, None, None, None), (None, 1, "user", "a."), (50, None, "user", "b."), (50, 3, "user", "c."),
        (50, 3, "user", "c."), (50, 3, "assistant", "c."), (50, 9, "assistant", "d."), (51, None, None, None),
    ]
    return rows


def test_report_equals_brute_force(spark):
    rows = odd_conversations()
    damaged = turn_repair.damaged(conversations(spark, rows).repartition(3))
    got = turn_repair.repair_report(damaged, "copies").collect()
    expected = {conv: brute_repair(rows) for conv, rows in brute_damage(rows).items()}
    assert len(got) == len(expected)
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected
    none = conversations(spark, rows).limit(0)
    assert turn_repair.repair_report(turn_repair.damaged(none), "copies").count() == 0


def test_repaired_rows_give_the_reported_hash(spark):
    damaged = turn_repair.damaged(conversations(spark, odd_conversations()))
    lines = defaultdict(list)
    for r in sorted(turn_repair.repaired(damaged, "copies").collect(), key=lambda r: r.position):
        assert r.position == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in turn_repair.repair_report(damaged, "copies").collect():
        text = "\n".join(lines[r.conv_id])
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        initials = "".join(line[:1] for line in lines[r.conv_id])
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_settled_rows_leave_memory():
    """A conversation in order is settled row by row, a very long one too; open rows are held."""

    def nodes(root):
        n, open_ = 0, [root]
        while open_:
            n += 1
            open_ += open_.pop().children
        return n

    repair, most, out = turn_repair.Repair(), 0, 0
    for i in range(20_000):
        out += len(repair.row("ua"[i % 2] + "x", "t.", ("", "truncated", "blank")[i % 7 == 3 or 2 * (i % 11 == 5)]))
        most = max(most, nodes(repair.root))
    cost, rest = repair.end()
    assert most < 200 and out + len(rest) >= 20_000 and cost > 0


def test_one_conversation_of_many_equal_and_long_rows(spark):
    long_text = "word " * 200_000 + "."
    rows = [(1, 0, "user", long_text)] + [(1, t, "assistant", "same.") for t in range(1, 400)] * 2
    damaged = turn_repair.damaged(conversations(spark, rows))
    got = turn_repair.repair_report(damaged, "copies").collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {1: brute_repair(brute_damage(rows)[1])}


# 7. token files through select


def test_documents_of_a_segment_come_by_select(monkeypatch):
    from curbside.llm import elias_fano, token_files

    pick = np.random.default_rng(3)
    ids = [pick.integers(0, 70_000, n).astype("<u4") for n in [*pick.integers(1, 40, 1500), 5000, *[1] * 700]]
    names = [None] * 300 + sorted(pick.integers(-(1 << 40), 1 << 60, len(ids) - 300).tolist())
    data = token_files.segment_bytes(names, [i.tobytes() for i in ids])
    monkeypatch.delattr(elias_fano.Sequence, "all")
    part, at = token_files.Segment(data), 0
    for docs, ends in part.documents():
        assert docs == names[at : at + len(docs)] and len(docs) <= elias_fano.STEP
        assert np.diff(ends).tolist() == [len(i) for i in ids[at : at + len(docs)]]
        assert part.tokens[ends[0] : ends[-1]].tolist() == np.concatenate(ids[at : at + len(docs)]).tolist()
        at += len(docs)
    assert at == len(ids)
    assert list(token_files.Segment(token_files.segment_bytes([], [])).documents()) == []


def test_a_frequent_id_is_dealt_to_several_tasks(spark, tmp_path):
    from curbside.llm.token_files import FILES, read_tokens, write_tokens

    rows = [(7 if i % 3 == 0 else i, prose(i, 6), "en", "s") for i in range(3000)]
    path = str(tmp_path / "files")
    # So small a table would be merged into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tokens(documents(spark, rows), path, WORD_BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.schema(FILES).parquet(path).groupBy("shard").sum("n_docs").collect()
    assert max(r[1] for r in shards) < 900
    found = sorted((r.start, r.doc_id) for r in read_tokens(spark, path).collect())
    assert [d for _, d in found] == sorted(r[0] for r in rows)
