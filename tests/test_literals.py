import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom.functions import literals as L


@pytest.mark.parametrize(
    ("src", "found"),
    [
        ("a='x';b=\"y\"", [("x", "sq"), ("y", "dq")]),
        ("a='it\\'s'", [("it\\'s", "sq")]),
        ("`p${q}r`", [("p", "tmpl_frag"), ("r", "tmpl_frag")]),
        ("`${'in'}`", [("in", "sq")]),
        ("`a${`b${c}`}d`", [("a", "tmpl_frag"), ("b", "tmpl_frag"), ("d", "tmpl_frag")]),
        ("`a${{k:'v'}}b`", [("a", "tmpl_frag"), ("v", "sq"), ("b", "tmpl_frag")]),
        ("// 'no'\n'yes'", [("yes", "sq")]),
        ("/* 'no' */'yes'", [("yes", "sq")]),
        ("x=/'/;'yes'", [("yes", "sq")]),
        ("return/['\"]/.test('yes')", [("yes", "sq")]),
        ("a=b/c;'yes'/2", [("yes", "sq")]),
        ("4/2;'yes'", [("yes", "sq")]),
        ("a=''", [("", "sq")]),
        ("``", []),
        ("'open", []),
    ],
)
def test_scan(src, found):
    raw = src.encode()
    assert [(raw[s:e].decode(), kind) for s, e, kind in L.scan(raw)] == found


@pytest.mark.parametrize("ascii_only", [False, True])
@given(text=st.text(alphabet=st.characters(blacklist_categories=["Cs"])), kind=st.sampled_from(["dq", "sq", "tmpl_frag"]))
def test_round_trip(text, kind, ascii_only):
    text = text.replace("\r\n", "\n")
    assert L.decode(L.encode(text, kind, ascii_only).encode()) == text


def test_decode_keeps_what_it_does_not_know():
    assert L.decode("\\qé\\x41".encode()) == "\\qéA"
    assert L.decode(b"\xff") is None
    assert L.decode(rb"\ud83d\ude00") == "😀"
    assert L.decode(rb"\ud83d!") == "\\ud83d!"
    assert L.decode(b"a\r\nb") == "a\nb"
    with pytest.raises(ValueError):
        L.encode("x", "other")


def test_forms_are_distinct():
    forms = L.search_forms('say "é"')
    assert forms[0] == ('say "é"', "raw")
    assert len({f for f, _ in forms}) == len(forms)


@pytest.mark.parametrize(
    ("src", "found"),
    [
        ('"a\nb"', [("a\nb", "dq")]),
        ("'a' \"open", [("a", "sq")]),
        ("`never ${x} closed", [("never ", "tmpl_frag")]),
        ("return/'/.test('yes')", [("yes", "sq")]),
        ("return /2;'yes'", [("yes", "sq")]),
        ("a /* ' */ /2/'yes'", [("yes", "sq")]),
        ("x=/[/']/g,'yes'", [("yes", "sq")]),
        ("`a${/}/}'b'`", [("a", "tmpl_frag"), ("'b'", "tmpl_frag")]),
        ("'\\\n'", [("\\\n", "sq")]),
        ("", []),
    ],
)
def test_scan_of_breaks_and_slashes(src, found):
    raw = src.encode()
    assert [(raw[s:e].decode(), kind) for s, e, kind in L.scan(raw)] == found


def test_codec_by_the_specification():
    assert L.decode(b"a\\r\\nb") == "a\nb"
    assert L.decode(rb"\uD83D \u{41} \0") == r"\uD83D \u{41} \0"
    assert L.encode("\b\f\v\0\t", "dq") == r"\x08\x0c\x0b\x00\t"
    assert L.encode("a\n'\"`$", "tmpl_frag") == "a\n'\"\\`\\$" and L.encode("a\n'", "sq") == "a\\n\\'"
    assert L.encode("\U0001f600é", "sq", ascii_only=True) == r"\ud83d\ude00\u00e9"
    assert L.search_forms('say "é"\n') == [('say "é"\n', "raw"), (r'say \"é\"\n', "dq"), (r'say \"\u00e9\"\n', "dq"), (r'say "é"\n', "sq"), (r'say "\u00e9"\n', "sq"), ('say "\\u00e9"\n', "tmpl_frag")]
