"""Pre-tokens cut by the standard library are those of ``regex``, and cost less."""

import random
import time

import public_tokenizers
import pytest
import regex

from lexiphyte.llm.bpe import cutter

PATTERN = public_tokenizers.PATTERN


@pytest.mark.parametrize("top", [0x80, 0x250, 0x3000, 0x10000, 0x110000])
def test_as_regex(top):
    draw, expected, cut = random.Random(top), regex.compile(PATTERN).findall, cutter(PATTERN)
    for _ in range(300):
        own = [chr(c) for c in draw.choices(range(top), k=80) if not 0xD800 <= c < 0xE000]
        text = "".join(draw.choices([*own, *" \n\t\x1c\x85\xa0\u2028'stremvd09aZ"], k=300))
        assert cut(text) == expected(text)
    for c in range(min(top, 0x10000)):  # each character after a letter, a blank, a number and a sign
        text = f"a{chr(c)} {chr(c)}1{chr(c)}!{chr(c)}"
        assert cut(text) == expected(text)


def test_other_patterns():
    assert cutter(r"\p{Lu}|.")("aÉ\U0001f600") == ["a", "É", "\U0001f600"]


def test_costs_less():
    text = "Wörter und Sätze, 1234 of them; the others' are\n\n plain. " * 2_000

    def least(cut):
        took = []
        for _ in range(5):
            began = time.process_time()
            cut(text)
            took.append(time.process_time() - began)
        return min(took)

    assert least(cutter(PATTERN)) < 0.75 * least(regex.compile(PATTERN).findall)
