"""Every corpus operator on odd rows, empty tables and against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from curbside.llm import language, suffix_dedup
from curbside.llm.credential_scan import credential_scan, redacted, scan_report
from curbside.llm.decontaminate import contamination, decontaminated
from curbside.llm.elias_fano import Sequence, encode
from curbside.llm.language import RIDGE, fit, language_ids, training_rows
from curbside.llm.line_quality import line_quality, quality_filtered
from curbside.llm.near_dedup import (
    block_links,
    deduplicated,
    near_duplicates,
    prob_minhash,
    similarity,
    weighted_sets,
)
from curbside.llm.packing import packed, piece_lengths
from curbside.llm.queries import ORACLES
from curbside.llm.suffix_dedup import repeated_passages
from curbside.llm.token_counts import CountingVocabulary, sentencepiece_vocabulary, token_counts
from curbside.llm.token_files import read_tokens, write_tokens
from curbside.llm.toxicity import bounded_sample, featurized, toxicity
from curbside.llm.wordcache import WordTokenizer
from tests.llm.frames import documents, odd_rows, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ITEMS = "item_id long, text string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")  # noqa: E501


def key(doc):
    return (doc is not None, doc or 0)


# 1. repeated passages


def brute_passages(rows):
    first, out = {}, []
    data = sorted(((d, (t or "").encode()) for d, t, *_ in rows), key=lambda x: key(x[0]))
    for doc, text in data:
        for i in range(len(text) - 49 if doc is not None else 0):
            first.setdefault(text[i : i + 50], doc)
    for doc, text in data:
        gone = bytearray(len(text))
        for i in range(len(text) - 49 if doc is not None else 0):
            if first[text[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000, 4 << 20])
def test_passages_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 9_000)
    pick = random.Random(3)
    shared = [prose(s, 30) for s in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(100 + i, pick.randint(0, 40))]
        for _ in range(pick.randint(0, 3)):
            passage = pick.choice(shared)
            at = pick.randint(0, 60)
            parts.insert(pick.randint(0, len(parts)), passage[at : at + pick.choice([48, 49, 50, 51, 90])])
        rows.append((i * 7 % 61, pick.choice(["", "é"]) + "".join(parts)))
    rows += [(200, "x" * 130), (201, "x" * 77), (202, "x" * 49), (203, rows[5][1]), (203, rows[5][1])]
    found = repeated_passages(documents(spark, rows))
    assert sorted(map(tuple, found.drop("removed").collect()), key=str) == brute_passages(rows)


def test_passages_of_odd_rows(odd, none):
    rows = [r for r in odd_rows() if r[0] not in (6, 7)] + [(6, odd_rows()[8][1]), (7, odd_rows()[9][1])]
    found = repeated_passages(odd).drop("removed").collect()
    assert sorted(map(tuple, found), key=str) == brute_passages(rows)
    assert repeated_passages(none).count() == 0


def test_passages_look_up_rows_not_places(monkeypatch):
    """Steps on a block look up its rows and ranges by binary search, never each place of a text."""
    rows = [(i // 2, prose(i % 7, 3000).encode() + prose(50 + i, 300).encode()) for i in range(20)]
    ids, texts = np.array([i for i, _ in rows]), [t for _, t in rows]
    sizes, known = np.array([len(t) for t in texts]), np.ones(len(rows), np.uint8)
    digests = b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts)
    values = [1, ids.tobytes(), known.tobytes(), sizes.tobytes(), digests, b"".join(texts)]
    names = suffix_dedup.BLOCKS.names
    block = pa.table({c: [v] for c, v in zip(names, values, strict=True)})
    plan, needles, search = suffix_dedup.Plan(int(sizes.sum())), [], np.searchsorted
    monkeypatch.setattr(
        np, "searchsorted", lambda a, v, *more, **named: needles.append(np.size(v)) or search(a, v, *more, **named)
    )
    answers = suffix_dedup.matched(0)(plan.send_digests(block.select(names[:-1])))
    for step, level in ((plan.send_tuples, 1), (plan.send_prefixes, 2)):
        answers = pa.concat_tables([answers, suffix_dedup.matched(level)(step(block, answers))])
    found = plan.remove(block, answers).drop_columns("removed").to_pylist()
    assert max(needles) <= len(rows)
    texts = [(i, t.decode()) for i, t in rows]
    assert sorted((tuple(r.values()) for r in found), key=str) == brute_passages(texts)


# 2. decontamination


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute_contamination(rows, items, size=10):
    windows = defaultdict(set)
    for item, text, *_ in items:
        w = words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    names |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [300, 32 << 20])
def test_contamination_matches_brute_force(spark, part_bytes):
    items = [(i, prose(i, 8 + 3 * i), "k") for i in range(12)] + [(50, "Tiny item"), (51, None), (None, prose(90, 14)), (1, prose(1, 11)), (53, "!!")]  # noqa: E501
    items = [(*x, "k")[:3] for x in items]
    rows = odd_rows()
    for i in range(40):
        passage = (items[i % 12][1] or "").split(" ")
        start = i % 5
        rows.append((100 + i, " ".join([prose(500 + i, 20), *passage[start : start + 6 + i % 9], "TINY", "item", prose(i, 3)])))  # noqa: E501
    bench = spark.createDataFrame(items, ITEMS)
    docs = documents(spark, rows)
    found = contamination(docs, bench, part_bytes=part_bytes)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = brute_contamination(rows, items)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == expected
    left = decontaminated(docs, bench, part_bytes=part_bytes)
    assert left.columns == docs.columns
    assert left.count() == sum(not r[-1] for r in expected)


def test_longest_match(spark):
    item = prose(1, 30)
    text = " ".join(["before", *item.split(" ")[4:21], "after", *item.split(" ")[:12]])
    found = contamination(documents(spark, [(1, text)]), spark.createDataFrame([(1, item, "")], ITEMS)).first()
    assert (found.longest_match, found.hit_spans) == (17, [1, 18, 19, 31])


def test_contamination_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], ITEMS)
    assert contamination(odd, empty).filter("contaminated").count() == 0
    assert contamination(none, empty).count() == 0
    assert decontaminated(odd, empty).count() == odd.count()


# 3. line quality


def test_frequent_lines_go_but_the_first_stays(spark):
    line = "Subscribe to our letter and never miss a thing again, dear reader of these pages"
    rows = [(i, f"{line.upper() if i % 2 else line}\n{prose(i, 60)}", "en", "host") for i in range(30)]
    rows += [(100 + i, "\n".join([line, f"short end {i}", prose(1000 + i, 45)]), "en", "host") for i in range(5)]
    rows += [(200, f"{line}\n{prose(7000, 60)}", "en", "other"), (201, rows[3][1], "en", "host")]
    verdict = {r.doc_id: r for r in line_quality(documents(spark, rows), min_words=50).collect()}
    assert verdict[0].n_removed_words == 0 and verdict[1].n_removed_words == 15
    assert verdict[200].n_removed_words == 0
    assert all(verdict[i].kept for i in range(30))
    assert not any(verdict[100 + i].kept for i in range(5))
    kept = {r.doc_id: r for r in quality_filtered(documents(spark, rows)).collect()}
    assert kept[0].text == rows[0][1]
    assert kept[4].text == rows[4][1].split("\n")[1] and kept[4].n_chars == len(kept[4].text)
    assert set(kept) == {*range(30), 200, 201}


def test_quality_of_odd_rows(odd, none):
    verdict = line_quality(odd).collect()
    assert len(verdict) == len(odd_rows())
    by = {r.doc_id: r for r in verdict}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[8].word_chars == len("é́日本語\U0001f600ÀÉﬁ")
    assert line_quality(none).count() == 0
    assert quality_filtered(odd).columns == odd.columns
    assert quality_filtered(none).count() == 0


# 4. packing


def check_pieces(pieces, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, held in by_doc.items():
        copies = len([p for p in held if p.start == 0])
        held = sorted(held, key=lambda p: (p.start, p.sequence_id))
        ids = ids_of[doc]
        for p in held:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes())
        assert sum(p.length for p in held) == copies * len(ids)
    for held in by_sequence.values():
        held.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in held])
        assert [p.offset for p in held] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    return by_sequence


def test_packing_round_trip(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows += [(300 + i, prose(i, 17 * i % 700)) for i in range(200)]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows}
    pieces = packed(documents(spark, rows).repartition(3), WORD_BPE).collect()
    sequences = check_pieces(pieces, ids)
    total = sum(p.length for p in pieces)
    assert total == sum(len(ids[r[0]]) for r in rows)
    assert total / (4096 * len(sequences)) > 0.93


def test_piece_lengths_fill_their_class():
    for n in range(1, 12_000, 7):
        pieces = piece_lengths(n, 4096, 0.97)
        assert sum(pieces) == n
        assert all(p * (4096 // p) >= 0.97 * 4096 or p <= 64 for p in pieces)


def test_packing_of_nothing(none):
    assert packed(none, WORD_BPE).count() == 0


# 5. toxicity


def test_toxicity_learns(spark):
    rows = [(i, prose(i, 40) + (" you utter blockhead" if i % 8 == 0 else "")) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1200, 2)], "doc_id long, toxic int")
    found = toxicity(documents(spark, rows), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.97


def test_toxicity_of_odd_rows(odd, none, labels):
    found = toxicity(odd, labels).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found)
    assert toxicity(none, labels).count() == 0
    assert toxicity(odd, labels.limit(0)).filter("predicted = 0").count() == len(odd_rows())


def test_a_repeated_id_counts_once_in_toxicity_training(spark):
    rows = [(i, prose(i, 20)) for i in range(6)] + [(3, prose(100 + i // 4, 20)) for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    docs = documents(spark, rows)
    found = [featurized(bounded_sample(ids, d, 6, "doc_id"), "text") for d in (docs, docs.repartition(5))]
    assert len(found[0]) == 6
    assert all((a == b).all() for a, b in zip(*found, strict=True))


# 6. language


def test_language_learns(spark):
    said = {"en": "the weather is nice and we walk along the river ", "de": "das wetter ist schön und wir gehen am fluss entlang ", "el": "ο καιρός είναι καλός και περπατάμε δίπλα στο ποτάμι "}  # noqa: E501
    rows = [(3 * i + j, " ".join(random.Random(i).sample(t.split(), 6)), lang) for i in range(80) for j, (lang, t) in enumerate(said.items())]  # noqa: E501
    found = {r.doc_id: r for r in language_ids(documents(spark, rows)).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    assert held and np.mean([found[d].lang_pred == lang for d, _, lang in held]) > 0.95


def test_languages_of_large_alphabets():
    """Languages with 1,500 characters of their own each, told apart by few words."""
    pick = random.Random(3)

    def text(k: int) -> str:
        return " ".join("".join(chr(0x4E00 + 1500 * k + pick.randrange(1500)) for _ in range(3)) for _ in range(12))

    model = fit([(f"l{k}", text(k)) for k in range(8) for _ in range(60)])
    tests = [(k, text(k)) for k in range(8) for _ in range(40)]
    found = model.scores([t for _, t in tests]).argmax(axis=1)
    assert np.mean(found == np.array([k for k, _ in tests])) > 0.95


def test_kernel_and_ridge_against_sets():
    """Kernels by Python sets; with all texts as landmarks, ridge regression solved on the whole
    kernel matrix."""
    texts = [("en" if i % 2 else "x", prose(i, 15) + ("é\u3000Ω" if i % 3 else "")) for i in range(24)]
    new = [prose(100 + i, 9) for i in range(5)] + ["", "日本"]
    grams = [
        {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
        for t in (f" {t.lower()} ".replace("\u3000", " ") for t in [x for _, x in sorted(texts, key=lambda r: r[0])] + new)
    ]
    known = set().union(*grams[:24])
    size = [len(g & known) for g in grams]
    kernel = np.array([[len(a & b) / max(1, p * q) ** 0.5 for b, q in zip(grams[:24], size[:24], strict=True)] for a, p in zip([g & known for g in grams], size, strict=True)])  # noqa: E501
    model = fit(texts)
    ordered = [t for _, t in sorted(texts, key=lambda r: r[0])] + new
    assert np.allclose(model.spectrum.rows(ordered) @ model.landmarks.T, kernel, atol=1e-5)
    target = np.where(np.repeat([0, 1], 12)[:, None] == np.arange(2), 1.0, -1.0)
    dual = np.linalg.solve(kernel[:24] + RIDGE * 24 * np.eye(24), target)
    assert np.allclose(model.scores(ordered), kernel @ dual, atol=1e-3)


def test_language_training_is_bounded(spark, monkeypatch):
    rows = [(i, prose(i, 20), "en" if i % 3 else "x", "a") for i in range(600)]
    rows += [(1, prose(1, 20), "en", "a")] * 300
    docs = documents(spark, rows)
    order = {t: i for i, (_, t) in enumerate(training_rows(docs, "doc_id", "text", "lang", 600))}
    some = training_rows(docs, "doc_id", "text", "lang", 30)
    for lang in ("en", "x"):
        whole = [t for k, t in training_rows(docs, "doc_id", "text", "lang", 600) if k == lang]
        assert [t for k, t in some if k == lang] == whole[:30]
    assert len(order) > 400
    monkeypatch.setattr(language, "LANGUAGE_BYTES", 500)
    short = training_rows(docs, "doc_id", "text", "lang", 30)
    for lang in ("en", "x"):
        mine = [t for k, t in short if k == lang]
        assert 1 <= len(mine) < 10 and sum(map(len, mine)) <= 500


def test_language_of_odd_rows(odd, none):
    found = {r.doc_id: r for r in language_ids(odd).collect()}
    assert {found[d].lang_pred for d in (1, 2, 3)} == {"und"}
    assert found[4].lang_pred in ("en", "ja") and 0 <= found[4].score <= 1
    assert language_ids(none).count() == 0


def test_a_repeated_id_counts_once_in_language_training(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, prose(i, 9), "en") for i in ids] + [(i, prose(50 + i, 9), "de") for i in ids[:3]]
    rows += [(hot, prose(200 + i // 4, 9), "en") for hot in ids for i in range(12)]
    found = training_rows(documents(spark, rows), "doc_id", "text", "lang", 10)
    assert [sum(lang == x for lang, _ in found) for x in ("en", "de")] == [10, 3]


# 7. token files


def test_elias_fano_round_trip():
    pick = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [1 << 62], range(3000), np.sort(pick.integers(0, 1 << 40, 999)), np.sort(pick.integers(0, 40, 5000))):  # noqa: E501
        values = np.array(list(values), dtype=np.int64)
        data = encode(values)
        sequence = Sequence(data)
        assert sequence.size == len(data) and len(sequence) == len(values)
        assert sequence.all().tolist() == values.tolist()
        for i in range(0, len(values), max(1, len(values) // 50)):
            assert sequence.select(i) == values[i]
    dense = np.sort(pick.integers(0, 1 << 30, 1 << 16))
    assert len(encode(dense)) < len(dense) * 17 / 8


@pytest.mark.parametrize("segment", [500, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, segment):
    rows = odd_rows() + [(40 + i, prose(i, i)) for i in range(50)]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    path = str(tmp_path / "tokens")
    write_tokens(documents(spark, rows).repartition(5), path, WORD_BPE, segment=segment)
    found = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (key(r[0]), r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == expected


def test_token_files_of_nothing(spark, none, tmp_path):
    write_tokens(none, str(tmp_path / "none"), WORD_BPE)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_word_tokenizer_equals_the_library():
    whole, mine = Tokenizer.from_file(WORD_BPE), WordTokenizer(WORD_BPE)
    texts = ["İ ß SS ﬁ ª º µ's don't it's 'S I'LL\x1cfoo <|endoftext|>bar<|startoftext|> x́ é a\u0085b\xa0c", "", "  ", "ÀÉÞ×÷ÿ, Ÿ! ſ K; ΑΣ ΑΣ.", "a" * 300, prose(1, 300)]  # noqa: E501
    for t in texts:
        assert mine.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_are_used_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, whole = WordTokenizer(path), Tokenizer.from_file(path)
    for t in ["Hello World again", "  two  spaces\n", "", prose(1, 50)]:
        assert mine.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


# 8. credentials


def test_credentials(spark):
    key_value = "Zx9yQw8vUt7sRq6pOn5mLk4jIh3g"
    rows = [
        (1, f'say é API_key = "abc123", AKIA{"Q" * 16} {"0af" * 9}', None, "a"),
        (2, f"secret: token: abcdefgh and password=ab and {key_value}", None, "b"),
        *[(10 + i, "example aB3dEfGhIjKlMnOpQrStUvWx", None, f"s{i}") for i in range(4)],
    ]
    found = {r.doc_id: r for r in scan_report(credential_scan(documents(spark, rows))).collect()}
    one = "assign:6:24,access:26:46,hex:47:74"
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex) == (1, 1, 1)
    text = rows[0][1]
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in found[1].spans.split(","))]
    assert [text[a:b] for _, a, b in spans] == ['API_key = "abc123', f"AKIA{'Q' * 16}", "0af" * 9]
    assert found[1].base_sha256 == hashlib.sha256(found[1].spans.encode()).hexdigest() and one
    assert found[2].n_assign == 0 and found[2].spans.startswith("opaque:")
    assert found[10].spans == ""
    clean = {r.doc_id: r.text for r in redacted(documents(spark, rows)).collect()}
    assert clean[1] == 'say é [SECRET]", [SECRET] [SECRET]' and key_value not in clean[2]
    assert clean[10] == rows[2][1]


def test_credentials_of_odd_rows(odd, none):
    found = scan_report(credential_scan(odd)).collect()
    assert len(found) == len(odd_rows()) and all(r.spans == "" for r in found)
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert redacted(odd).columns == odd.columns and redacted(odd).count() == odd.count()
    assert scan_report(credential_scan(none)).count() == 0


def test_owners_and_repositories_of_values(spark):
    """Null owners and repeated rows; one owner's value stays live in any number of documents."""
    keys = [f"aB{i}dEfGhIjKlMnOpQrStUvWxYz" for i in range(4)]
    rows = [(i, f"own {keys[0]}", None, "a") for i in range(30)]
    rows += [(100 + i, f"mirror {keys[1]}", None, "ab"[i % 2]) for i in range(30)]
    rows += [(200 + i % 2, f"again {keys[2]}", None, "ab"[i % 2]) for i in range(30)]
    rows += [(300, keys[3], None, None), (301, keys[3], None, "a"), (302, keys[3], None, "b")]
    docs = documents(spark, rows)
    found = scan_report(credential_scan(docs)).collect()
    held = {(r.doc_id, r.most_owners, r.most_repositories, r.n_live) for r in found}
    assert held == {(i, 1, 30, 1) for i in range(30)} | {(100 + i, 0, 0, 0) for i in range(30)} | {
        (200, 2, 2, 1), (201, 2, 2, 1), (300, 0, 0, 0), (301, 0, 0, 0), (302, 0, 0, 0)
    }
    con = duckdb.connect()
    documents_table = docs.toArrow()
    con.register("documents", documents_table)
    expected = con.execute(ORACLES["op8_credential_scan"])
    names = [c[0] for c in expected.description]
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(expected.fetchall())


def test_redaction_of_overlaps_and_many_spans(spark):
    """Against a loop over the reported spans; chunk borders, astral characters, 100,000 spans."""
    pick = random.Random(5)
    bits = ["token=" + "0af" * 9, "secret: abcdefgh", "AKIA" + "Q7" * 9, "\U0001f600 é ", "x " * 600, "\n"]
    texts = ["".join(pick.choices(bits, k=pick.randint(0, 40))) for _ in range(60)]
    texts += ["0af" * 9 + " ", "0af" * 341 + "0", "é" * 1024 + "0af" * 9, ("0af" * 9 + ", ") * 100_000]
    docs = documents(spark, [(i, t, None, "a") for i, t in enumerate(texts)])
    spans = {r.doc_id: r.spans for r in scan_report(credential_scan(docs)).collect()}
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    for i, text in enumerate(texts):
        out, at = [], 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + text[at:]
    assert spans[63].count(",") == 99_999


# 9. token counts


@pytest.mark.parametrize("bytes_too", [True, False])
def test_counts_equal_the_library(bytes_too):
    pieces = [(p, s) for p, s in sentencepiece_vocabulary(PIECES) if bytes_too or not p.startswith("<0x")]
    library = Tokenizer(models.Unigram(pieces, 0, bytes_too))
    library.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    mine = CountingVocabulary(pieces)
    texts = ["", " ", "  a  b", "▁x ▁▁y", "日本語 \n\n x\ny é́ \U0001f600\U0001f600", "<0x41> <s> aaaa", "a\n", "\na", *[prose(i, 50) for i in range(20)]]  # noqa: E501
    for t in texts:
        assert mine.count(t)[0] == len(library.encode(t).ids)


def test_ties_go_to_the_longest_last_piece():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    mine = CountingVocabulary(pieces)
    for t in ("ab", "aab", "bab", "abab zz", "zza b"):
        assert mine.count(t)[0] == len(library.encode(t).ids)


def test_counts_of_odd_rows(odd, none):
    found = {r.doc_id: r for r in token_counts(odd, PIECES).collect()}
    assert found[1].n_tokens == 0 and found[2].score == 0 and found[1 << 60].n_tokens > 0
    assert token_counts(none, PIECES).count() == 0


# 10. near-duplicates


def edited(text, share, seed):
    pick = random.Random(seed)
    return " ".join(w if pick.random() > share else f"{w}q" for w in text.split(" "))


def test_classes_match_brute_force(spark):
    rows = []
    for g in range(12):
        base = prose(g, 40 + 20 * g)
        for k in range(8):
            rows.append((len(rows), base if k == 0 else edited(base, [0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2][k - 1], 50 * g + k)))  # noqa: E501
    rows += [(500, "few words"), (501, "Few, words!"), (502, "few"), (503, "x " * 400), (504, "x " * 380)]
    random.Random(5).shuffle(rows)
    sets = [s for _, s in weighted_sets([t for _, t in rows])]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    found = near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {d: root(d) for d, _ in rows}
    assert {r.doc_id for r in found if r.kept} == {root(d) for d, _ in rows}


def test_unequal_repeat_counts_are_one_class(spark):
    rows = []
    for g, (often, seldom) in enumerate([(200, 1), (50, 1), (100, 1), (200, 2)]):
        passage, rest = prose(3000 + g, 100), prose(4000 + g, 900)
        rows += [(10 * g + i, " ".join([*[passage] * n, rest])) for i, n in enumerate((often, seldom))]
    sets = [s for _, s in weighted_sets([t for _, t in rows])]
    for a, b in zip(sets[::2], sets[1::2], strict=True):
        assert similarity(a, b) > 0.99
    found = near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {d: d - d % 10 for d, _ in rows}
    assert {r.doc_id for r in found if r.kept} == {0, 10, 20, 30}


def test_near_duplicates_of_odd_rows(odd, none):
    found = near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    classes = {r.doc_id: r.class_id for r in found}
    assert classes[5] == 4 and classes[7] == 6 and classes[2] == 2 and classes[3] == 3
    kept = [r.doc_id for r in deduplicated(odd).collect()]
    assert sorted(d for d in kept if d is not None) == [1, 2, 3, 4, 6, 8, 1 << 60]
    assert near_duplicates(none).count() == 0 and deduplicated(none).count() == 0


def test_registers_estimate_probability_jaccard():
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = (a[:300], np.ones(300, np.int64))
    two = (a[60:360], np.where(np.arange(300) < 40, 3, 1))
    registers = prob_minhash([one, two], 4000)
    assert abs((registers[0] == registers[1]).mean() - exact_jaccard(one, two)) < 0.03


def exact_jaccard(a, b):
    x, y = (dict(zip(s.tolist(), w.tolist(), strict=True)) for s, w in (a, b))
    both = x.keys() | y.keys()
    return sum(
        1 / sum(max(x.get(z, 0) / x[d], y.get(z, 0) / y[d]) for z in both) for d in x.keys() & y.keys()
    )


def test_similarity_is_exact():
    pick = np.random.default_rng(2)
    for _ in range(20):
        a, b = (np.sort(pick.choice(60, 40, replace=False)).astype(np.uint64) for _ in range(2))
        u, v = pick.integers(1, 6, 40), pick.integers(1, 6, 40)
        plain = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert similarity((a, u), (b, v)) == pytest.approx(plain)


def test_a_line_repeated_in_different_texts_is_no_link(spark):
    line = " ".join([prose(7, 20)] * 100)
    rows = [(i, f"{prose(100 + i, 104)} {line}") for i in range(6)]
    found = near_duplicates(documents(spark, rows)).collect()
    assert all(r.kept and r.class_id == r.doc_id for r in found)


def test_recall_on_documents(spark):
    """Classes of all documents of sf0.01 are those of all pairs with a set Jaccard of 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(len(s[0]), r.doc_id, s) for r, (_, s) in zip(rows, weighted_sets([r.text for r in rows]), strict=True)]
    items.sort(key=lambda x: x[:2])
    links = 0
    for i, (n, d, s) in enumerate(items):
        for m, e, t in items[i + 1 :]:
            if 0.8 * m > n:
                break
            if n and similarity(s, t) >= 0.8:
                links += 1
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    assert links > 50
    assert found == {d: root(d) for d in parent}


def test_blocks_find_links_between_components():
    base = np.arange(100, dtype=np.uint64)
    sets = [(np.sort(np.append(base[: 100 - k], np.uint64(1000 + k))), np.ones(101 - k, np.int64)) for k in range(6)]
    found = block_links([10, 11, 12, 13, 14, 15], [1, 1, 2, 2, 3, 3], np.ones(6, bool), True, sets, 0.8)
    assert len(found) == 2
