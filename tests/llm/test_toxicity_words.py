"""Words of a run, with and without the short cut for runs of letters."""

import re
import sys

from cadence.llm import toxicity


def test_letters_are_what_words_are_made_of():
    every = [chr(i) for i in range(sys.maxunicode + 1)]
    letters = [c for c in every if c.isalpha()]
    assert all(toxicity._WORD.fullmatch(c) for c in letters)
    assert toxicity._WORD.findall("".join(letters)) == ["".join(letters)]


def test_terms_of_runs(monkeypatch):
    words = ["abc", "abcdef", "é", "x", "中文"]
    plain, starts = toxicity.Vocabulary(words), toxicity.Vocabulary([*words, "^abcd"])
    runs = ["abc", "abc,x-abc", "abcdef", "a1x_é", "中文", "…", "abcdefg", "nothing", "²x", ""]
    want = [[w for w in re.findall(r"[^\W\d_]+", r) if w in words] for r in runs]
    assert [[plain.terms[i] for i in plain.terms_in(r)] for r in runs] == want
    assert [starts.terms[i] for i in starts.terms_in("abcdefg")] == ["^abcd"]
    calls = []
    monkeypatch.setattr(toxicity, "_WORD", type("R", (), {"findall": lambda self, r: calls.append(r) or [r]})())
    plain.terms_in("abc")
    assert not calls
