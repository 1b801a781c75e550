import random

import numpy as np

from metricledger.llm import substring

SCHEMA = "doc_id long, text string, lang string, start string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(rnd, words):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rnd.randint(2, 9))) for _ in range(words))


def ends_of(text):
    return substring.chunk_ends(np.frombuffer(text.encode(), np.uint8)).tolist()


def test_gear_hash_rolls():
    data = np.frombuffer(prose(random.Random(1), 30).encode(), np.uint8)
    h, plain = 0, []
    for b in data.tolist():
        h = ((h << 4) + int(substring.GEAR[b])) & 0xFFFFFFFF
        plain.append(h)
    assert substring.gear_hash(data).tolist() == plain


def test_ends_depend_on_what_is_near():
    rnd = random.Random(2)
    text = prose(rnd, 400)
    data = text.encode()
    ends = [e for e in ends_of(text) if e < len(data)]
    h = substring.gear_hash(np.frombuffer(data, np.uint8)).tolist()
    reach = substring.REACH
    tops = {i + 1 for i in range(reach, len(data) - 1) if h[i] > max(h[i - reach : i]) and h[i] >= max(h[i + 1 : i + 1 + reach])}
    moved = {t + next(k for k in range(4) if data[t + k] & 0xC0 != 0x80) for t in tops}
    assert moved <= set(ends)
    # an insertion changes the ends near it and no others
    changed = text[:700] + "an insertion " + text[700:]
    shift = len("an insertion ".encode())
    at = len(text[:700].encode())
    before = {e for e in ends if e < at - 40} | {e + shift for e in ends if e > at + 160}
    assert before <= set(ends_of(changed))


def test_no_chunk_is_empty_long_or_divides_a_character():
    rnd = random.Random(3)
    for text in ["", "a", "é" * 500, "ab " * 900, "中" * 61, prose(rnd, 200)] + ["".join(rnd.choice("aé中😀 ") for _ in range(rnd.randint(1, 80))) for _ in range(300)]:
        data, at = text.encode(), 0
        for e in ends_of(text):
            assert 0 < e - at <= substring.LONGEST + 3
            data[at:e].decode()
            at = e
        assert at == len(data)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rnd = random.Random(4)
    passages = [prose(rnd, 52) for _ in range(40)]
    rows = [(i, prose(rnd, rnd.randint(1, 90)) + " " + passages[i % 40] + " " + prose(rnd, rnd.randint(1, 90))) for i in range(120)]
    line = prose(rnd, 14)
    rows += [(1_000 + i, prose(rnd, 120) + "\n" + line + "\n" + prose(rnd, 30)) for i in range(30)]
    rows += [(2_000, None), (2_001, ""), (None, passages[0]), (2_002, "word " * 300), (0, rows[0][1])]
    docs = docs_of(spark, rows)
    got = substring.repeats(docs).collect()
    found = {(r.doc_id, r.first_doc_id) for r in got}
    assert found == {(i, i % 40) for i in range(40, 120)}
    texts = dict(rows[:150])
    for r in got:
        assert texts[r.doc_id].encode()[r.start : r.start + r.length] in texts[r.first_doc_id].encode()
    left = substring.cut(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    after = {}
    for r in left.collect():
        after.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, after.values())) == len(rows)
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in rows:
        want = t
        if i in spans:
            data, at, kept = t.encode(), 0, b""
            for s, n in sorted(spans[i]):
                kept, at = kept + data[at:s], s + n
            want = (kept + data[at:]).decode()
        assert want in [r.text for r in after[i]]
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after[i])


def test_whole_copies_go(spark):
    text = prose(random.Random(5), 100)
    assert [(r.doc_id, r.text) for r in substring.cut(docs_of(spark, [(2, text), (1, text)])).collect()] == [(1, text)]
    assert substring.cut(docs_of(spark, [])).count() == 0
