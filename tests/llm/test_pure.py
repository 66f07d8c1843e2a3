"""What needs no Spark: tokenizers against their libraries, detectors and templates against plain code."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import byte_bpe, chat_tree, html_extract, html_pages, pii, sstable
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "A", "b", " ", "  ", "\n", "\t", " ", "\x1c", "\x1f", "\x85", "　", "é", "ß", "1", "٣", "'s", "'", "!", "</s>", "😀", "́", "ab", "the", "ing", " the", "\r", "\x0b", "​", "日本", "Σ", "ΑΣ", "İ", "̸", "=", "\x01", "<|x", "<|endoftext|>"]


def texts(n, seed, pieces=PIECES, most=14):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_byte_bpe_equals_tiktoken(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    words = byte_bpe.Vocabulary(bpe.ranks)
    for t in [*texts(4000, 1), "x" * 5000, "ab" * 3000, " " * 3000]:
        ids = bpe.encode(t).tolist()
        assert ids == told.encode_ordinary(t) and words.decode(ids) == t.encode()
    with pytest.raises(ValueError):
        words.decode([len(words.sizes)])


def test_tables_stay_bounded_within_a_long_text(bpe, monkeypatch):
    """Segments, steps and slices of any size give the same ids, and distinct words by the hundred thousand stay out of memory."""
    tiktoken = pytest.importorskip("tiktoken")
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for name, value in (("SEGMENT", 200), ("STEP", 50), ("DECODED", 333)):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(bpe, "cache", byte_bpe.GenerationCache(40_000))
    long = " ".join(f"w{i * 7919 % 100003:x}" for i in range(20_000)) + " \n\n  end" + "ab,c.d" * 3000
    ids, words = bpe.encode(long), byte_bpe.Vocabulary(bpe.ranks)
    assert ids.tolist() == told.encode_ordinary(long) and words.decode(ids) == long.encode()
    assert bpe.cache.size <= 80_000 and len(bpe.cache.old) <= 80_000 // byte_bpe.ENTRY_BYTES


def test_words_encode_as_whole_texts_do():
    enc = sstable.WordEncoder(P.path("word_bpe_49k.json"))
    for t in texts(4000, 2):
        assert np.frombuffer(enc.encode(t.encode()), enc.kind).tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_capitals_before_combining_marks_encode_as_in_the_library():
    enc = sstable.WordEncoder(P.path("word_bpe_49k.json"))
    for t in ("H\u0331", "T\u0308 X\u0304", "the W\u030a, J\u030c", "\u00c9t\u00c9### \u00dcber,", "\u0130\u00d7\u00df \u00c9\u0301"):
        assert np.frombuffer(enc.encode(t.encode()), enc.kind).tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_a_batch_encodes_each_distinct_part_once(monkeypatch):
    monkeypatch.setattr(sstable, "WORDS_CACHED", 0)
    enc, made = sstable.WordEncoder(P.path("word_bpe_49k.json")), []
    encode = enc._encode_part
    monkeypatch.setattr(enc, "_encode_part", lambda part: (made.append(part), encode(part))[1])
    some = [" ".join(f"w{chr(97 + (i + j) % 26)}{'###,'[: j % 5]}" for j in range(60)) for i in range(40)] + [None, "", "\u00c9a \u00e9A <|endoftext|> x"]
    for kind in (pa.string(), pa.large_string()):
        made.clear()
        out = enc.encode_all(pa.array(some, kind))
        assert [np.frombuffer(x, enc.kind).tolist() for x in out] == [enc.library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert len(made) == len(set(made)) <= 26 + 5


def test_cache_never_changes_results():
    cache, made = byte_bpe.GenerationCache(3 * byte_bpe.ENTRY_BYTES), []
    for keys in (["a", "b"], ["c", "d"], ["a", "e", "a"], ["f"], ["a"]):
        assert cache.fill(keys, lambda k: (made.extend(k), [x * 2 for x in k])[1]) == [k * 2 for k in keys]


def test_table_file(tmp_path):
    path, rows = str(tmp_path / "t.sst"), [(None, [1]), (-5, [7] * 40000), (0, []), (3, [2, 3]), (3, [4]), (2**62, [9])]
    w = sstable.TableWriter(path, 2)
    for i, ids in rows:
        w.add(sstable.key_of(i), np.array(ids, np.uint16).tobytes())
    with pytest.raises(ValueError):
        w.add(sstable.key_of(0), b"")
    w.close()
    r = sstable.TableReader(path)
    assert [(i, x.tolist()) for i, x in r.scan()] == rows and (r.documents, r.tokens) == (6, 40005)
    assert [x.tolist() for x in r.get(3)] == [[2, 3], [4]] and r.get(None)[0].tolist() == [1] and r.get(77) == [] and len(r.index) > 1


def test_detectors_equal_the_patterns():
    for t in texts(20000, 3, list("a1@.-+ 12(9)b_%\n"), 40):
        assert pii.detect(t) == brute.private(t)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john at example dot com now", ["john at example dot com"]), ("j [at] ex (dot) org", ["j [at] ex (dot) org"]), ("plus one two three four five six seven eight nine", ["plus one two three four five six seven eight nine"]),
        ("ｊohn＠exаmple．com", ["ｊohn＠exаmple．com"]), ("192 dot 168 dot 1 dot 20", ["192 dot 168 dot 1 dot 20"]), ("we met at noon, un deux", []), ("a@b.cd", ["a@b.cd"]), ("", []),
    ],
)
def test_disguises_map_back_to_the_source(text, found):
    _, spans = pii.find(text)
    assert [text[a:b] for _, a, b in spans] == found
    assert all(f not in pii.redact(text, spans) for f in found)


@pytest.mark.parametrize(
    ("text", "base", "whole"),
    [
        ("to j\u043ehn@example.com now", "hn@example.com", "j\u043ehn@example.com"), ("john@example.c\u043em", "john@example.c", "john@example.c\u043em"),
        ("+49 170 555 one two three four", "+49 170 555", "+49 170 555 one two three four"),
    ],
)
def test_a_fragment_does_not_hide_the_whole_identifier(text, base, whole):
    plain, spans = pii.find(text)
    assert [text[a:b] for _, a, b in plain] == [base] and plain[0] in spans
    assert sorted(text[a:b] for _, a, b in spans) == sorted([base, whole])
    assert whole[:3] not in pii.redact(text, spans) and whole[-3:] not in pii.redact(text, spans)


@pytest.mark.parametrize(
    "address",
    [
        "john dot doe at example dot com", "john dot q dot doe at example dot com", "john dot q.doe at example dot com", "john.q dot doe@example.com", "a dot b dot c dot d dot e dot f dot g at example dot com",
        "a dot b.c dot d.e dot f punkt g [at] example [dot] com",
    ],
)
def test_spelled_dots_of_local_parts(address):
    text = f"mail: {address}, thanks"
    _, spans = pii.find(text)
    assert address in [text[a:b] for _, a, b in spans] and pii.redact(text, spans) == "mail: [EMAIL], thanks"


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("host one nine two dot one six eight dot one dot two.", "ip", "one nine two dot one six eight dot one dot two"), ("10.zwei.0.seven", "ip", "10.zwei.0.seven"), ("at 192 dot one six eight dot 1 dot zwei", "ip", "192 dot one six eight dot 1 dot zwei"),
        ("call +49 one seven zero 555 1234", "phone", "+49 one seven zero 555 1234"), ("plus 49 (170) 555 one 2 3 4", "phone", "plus 49 (170) 555 one 2 3 4"), ("+49 170 51 three", "phone", "+49 170 51 three"),
        ("4111 one one one one 1111-1111", "card", "4111 one one one one 1111-1111"), ("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("ask john.doe at example.com", "email", "john.doe at example.com"), ("john @ example.com", "email", "john @ example.com"), ("j_doe at mail.example.com", "email", "j_doe at mail.example.com"), ("john dot doe at example.com", "email", "john dot doe at example.com"),
    ],
)
def test_short_spelled_groups_and_real_domains(text, kind, found):
    _, spans = pii.find(text)
    assert [text[a:b] for k, a, b in spans if k == kind] == [found]
    assert found[:6] not in pii.redact(text, spans) and found[-4:] not in pii.redact(text, spans)


@pytest.mark.parametrize("text", ["one of the two, three or four", "one. two. three. four.", "look at example.com", "2 at 3.50 @ 4.20", "version two point five", "one, two, 3, four or five at no. 6", "un deux trois", "since 2019 at example.com"])
def test_ordinary_numbers_and_places_stay(text):
    assert pii.find(text) == ([], [])


def test_a_word_after_a_whole_phone_stays():
    text = "+1 (848) 555-1373 Un an"
    assert pii.find(text) == (pii.detect(text), pii.detect(text))


def test_walks_from_signs_are_linear():
    text = "a dot " * 30000 + "b@c.de " + "x@" * 30000
    assert pii.find(text)[1][0] == ("email", 0, 6 * 30000 + 6)


def test_chat_template_is_reversible():
    marks = ["<", "<<", ">", ">>", "\\", "s>", "/s>", "[", "]", "[INST]", "[/INST]", "</s>", "<s>", " ", "\n", "a", "<</>>", "INST]", "/"]
    r = random.Random(5)
    for _ in range(8000):
        rows = [(r.choice(["user", "assistant", "system", "<<x>>", "<s>>", ""]), "".join(r.choice(marks) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(1, 4))]
        assert chat_tree.parse("".join(chat_tree.format_turn(*x)[0] for x in rows)) == rows


def test_html_held_out_pages():
    model = html_extract.train(html_pages.labelled_pages())
    pages = list(html_pages.held_out(100))
    assert sum(model.extract(p) == want for p, want in pages) >= 95
    assert model.extract("") == "" and model.extract("<p>") == "" and model.extract("<div>" * 3000 + "x") is not None
    marginals = model.marginals(html_extract.Dom(pages[0][0]))
    assert all(0 <= m <= 1 for m in marginals)


def test_messages_equal_enumeration():
    """Marginals of a small page against the sum over all labelings."""
    model = html_extract.train(html_pages.labelled_pages(60))
    dom = html_extract.Dom("<body><nav><a href='/'>home</a></nav><article><p>Some words here.</p></article></body>")
    ev, n = dom.evidence(), len(dom.kind)
    total, good = 0.0, [0.0] * n
    for bits in range(0, 1 << n, 2):
        label = [bits >> i & 1 for i in range(n)]
        p = 1.0
        for i in range(n):
            for f in ev[i][1]:
                p *= model.feature.get(f, [1.0, 1.0])[label[i]]
            if i:
                p *= model._tie(ev[i][0])[2 * label[dom.parent[i]] + label[i]]
        total += p
        good = [g + p * x for g, x in zip(good, label, strict=True)]
    assert model.marginals(dom) == pytest.approx([g / total for g in good], abs=1e-9)


def test_malformed_pages_leak_no_markup_and_stay_linear():
    import time

    model = html_extract.train(html_pages.labelled_pages(60))
    page = "<body><nav><a href='/'>home</a></nav><article><p title=it's>Some words here and there.</p><p a=\"x>y\">And some more of them.</p><p class='open>Last words of all.</p></article></body>"
    assert model.extract(page) == "Some words here and there.\nAnd some more of them.\nLast words of all."
    for junk in ("<div>", '<p a="x>', "<", "<a ", "</div>", "<li>", "<!-- ", "='"):
        began = time.time()
        model.extract("x" + junk * 20000)
        assert time.time() - began < 4
