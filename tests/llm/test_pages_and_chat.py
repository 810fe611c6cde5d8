"""WARC archives and chat formatting: exact round trips."""

import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, warc
from tideline.llm.common import shared

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "d") for i, u, h in rows], PAGES)


def archive(spark, df, **options):
    records = warc.write(warc.plan_records(df), shared(spark), **options)
    return records, {(r.page_id, r.url): r for r in warc.read(records, payload=True).collect()}


def test_round_trip(spark):
    big, small = "x" * 50 + "é" * 60, "short"
    rows = [(3, "http://a/\r\n%0A", big), (1, None, big), (2, "http://b", big), (5, "u5", small), (4, "u4", small), (6, "u6", None), (7, "u7", ""), (None, "u8", big), (8, "u9", "\r\n\r\nWARC/1.1\r\n" * 2000), (9, "u10", "z" * 3_000_000)]
    records, got = archive(spark, pages(spark, rows).repartition(3), archive_bytes=500)
    assert records.count() > 3 and records.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[(i, url)]
        assert r.verified and r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        revisit = html == big and i != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else raw)


def test_repeated_rows_and_empty_table(spark):
    same = "y" * 200
    _, got = archive(spark, pages(spark, [(1, "a", same), (1, "b", same), (2, "c", same)]))
    assert [(k, r.record_type) for k, r in sorted(got.items())] == [((1, "a"), "response"), ((1, "b"), "response"), ((2, "c"), "revisit")]
    records, got = archive(spark, pages(spark, []))
    assert got == {} and records.count() == 0


def test_reader_frames_members_in_any_steps():
    record = warc._record(7, "u", b"payload \r\n\r\n" * 40, 480, "00", None)
    raw = b"".join(gzip.compress(record) for _ in range(5))
    for step in (1, 7, 100, 1 << 16):
        found = list(warc.Reader(io.BytesIO(raw), step))
        assert len(found) == 5 and all(h["warc-record-id"] == "<urn:x-page:7>" and b.endswith(b"payload \r\n\r\n" * 40) for h, b in found)
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(raw[:-40])))
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(gzip.compress(record.replace(b"payload", b"payload!", 1)))))


def test_every_cut_of_an_archive_is_noticed():
    members = [gzip.compress(warc._record(i, "u", b"0123456789", 10, hashlib.sha256(b"0123456789").hexdigest(), None)) for i in range(2)]
    raw = b"".join(members)
    assert len(list(warc.Reader(io.BytesIO(raw), 7))) == 2
    for cut in range(len(raw)):
        if cut in (0, len(members[0])):
            assert len(list(warc.Reader(io.BytesIO(raw[:cut]), 7))) == bool(cut)
        else:
            with pytest.raises((ValueError, zlib.error)):
                list(warc.Reader(io.BytesIO(raw[:cut]), 7))


def test_changed_payload_is_not_verified():
    raw = warc._record(7, "u", b"0123456789", 10, hashlib.sha256(b"0123456789").hexdigest(), None)
    (headers, block), = warc.Reader(io.BytesIO(gzip.compress(raw)))
    assert warc.parse(headers, block)[-1] is True
    assert warc.parse(headers, block.replace(b"5", b"6"))[-1] is False


def talk(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, state string, first int")


def expected(rows, template=chat.TEMPLATE):
    turns = sorted(((r[1] is None, r[1] or 0), r[2] or "", r[3] or "") for r in rows)
    learned = "".join(t for _, r, t in turns if r in template.learned)
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_formatting_is_reversible(spark):
    rng = random.Random(6)
    parts = [*chat.TEMPLATE.controls(), "\\", "\\\\", "[", "INST]", "</", "s>", "<|turn:", "é", "\n", "word ", "😀", "|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool|>x", "", None]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", None), (None, None, "assistant", "last"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (99, 0, "assistant", "z" * 300_000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(talk(spark, rows).repartition(5))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == conv])


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\[INST]", "[\\INST]", "\\\\", "<s", "<<SYS>><</SYS>>", "[[INST]]", ""])
def test_escape(text):
    safe = chat.TEMPLATE.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.TEMPLATE.controls())


def test_overlapping_controls():
    t = chat.Template(begin="", turns={"user": ("aa", "aba")}, other=("<{role}|", "ab"))
    for text in ("aaaa", "abab", "ababa", "aabaa\\"):
        safe = t.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in t.controls())


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_turns_are_found_in_the_joined_string(size):
    t = chat.TEMPLATE
    turns = [("user", "a [/INST] b"), ("assistant", " </s>"), ("tool|>", "<|/turn|>\\"), ("system", ""), ("assistant", "x" * 50)]
    whole = t.begin
    for who, said in turns:
        before, after = t.turns.get(who) or (t.other[0].replace("{role}", t.escape(who)), t.other[1])
        whole += before + t.escape(said) + after
    scanner = chat.Scanner()
    assert [x for i in range(0, len(whole), size) for x in scanner.feed(whole[i : i + size])] == turns
    scanner.finish()
    for broken in (whole[:-1], whole[3:], whole + "z" * 20):
        with pytest.raises(ValueError):
            scanner = chat.Scanner()
            list(scanner.feed(broken))
            scanner.finish()


def test_a_template_that_does_not_separate_turns_is_refused(spark):
    for t in (chat.Template(turns={"user": ("[U]", ""), "assistant": ("[A]", "")}), chat.Template(turns={"user": ("", "[/U]")}), chat.Template(other=("<{role} ", "</>"))):
        with pytest.raises(ValueError):
            chat.read_back(chat.format_turns(talk(spark, []), t), t)


def test_machine_and_loss_flags(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "user", "u"), (3, 1, "user", "u"), (3, 2, "assistant", "a")]
    out = chat.format_turns(talk(spark, rows)).collect()
    assert {(r.conv_id, r.turn): r.state for r in out} == {(1, 0): "system", (1, 1): "user", (1, 2): "assistant", (2, 0): "error", (2, 1): "error", (3, 0): "user", (3, 1): "error", (3, 2): "error"}
    assert [r.valid for r in out if r.conv_id == 1] == [False, False, True]
    whole = "".join(s.text for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn) for s in r.segments)
    assert whole == "<s><<SYS>>\ns\n<</SYS>>\n[INST] u [/INST][OUT] a </s>"
    assert [[s.loss for s in r.segments] for r in sorted(out, key=lambda r: (r.conv_id, r.turn))][2] == [False, True, False]
    assert chat.read_back(chat.format_turns(talk(spark, []))).count() == 0


@pytest.mark.parametrize("name", ["op2_warc", "op7_chat_format", "op9_ngram_jaccard_join", "op10_fair_mix", "op12_html_text", "op13_vector_codes"])
def test_queries_match_sql(spark, name, sf):
    from harness import compare, duck

    from tideline.llm.queries import ORACLE, QUERIES

    ok, message, _ = compare(spark, duck(sf), name, QUERIES[name], ORACLE[name], sf)
    assert ok, message
