"""Blobs that touch other characters or are wrapped, and escape runs of which a part is no text."""

import base64
import gzip
import random
import zlib

import pytest

from lexiphyte.llm import secrets

INNER = "see é token=abcdef123456 and more of the same text"
NOISE = "".join(random.Random(3).choices("qwrtzpsdfghjklyxcvbnm ", k=400))


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


@pytest.mark.parametrize("before", ["https://x/p/", "id-", "a_", "x/", "-----BEGIN-----\n", "k", "zq", "Qx7", "Wv8kkQ"])
@pytest.mark.parametrize("pack", [str.encode, lambda x: gzip.compress(x.encode(), mtime=0), lambda x: zlib.compress(x.encode())])
def test_touching(before, pack):
    blob = b64(pack(INNER))
    text = f"é {before}{blob} end"
    at, end = 2 + len(before), 2 + len(before) + len(blob)
    spans = secrets.find_secrets(text)[1]
    assert spans and all(k == 0 and at - 6 <= a <= at and e == end for a, k, e in spans)
    if before[-1] in "/-_\n":
        assert spans == [(at, 0, end)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("pack", [str.encode, lambda x: gzip.compress(x.encode(), mtime=0)])
def test_wrapped(end, pack):
    for shift in range(40, 60):  # the secret crosses a line end at some
        blob = b64(pack(NOISE[:shift] + INNER + NOISE))
        wrapped = end.join(blob[k : k + 76] for k in range(0, len(blob), 76))
        assert secrets.find_secrets(f"é {wrapped}\nThe end.")[1] == [(2, 0, 2 + len(wrapped))]


def test_parts_of_escapes():
    inner = "token=abcdef123456"
    for form, bad in (("%{:02x}", "%ff"), ("\\x{:02x}", "\\xc3"), ("\\u{:04x}", "\\ud800")):
        run = "".join(form.format(ord(c)) for c in inner)
        assert secrets.find_secrets(f"é {run}{bad}")[1] == [(2, 0, 2 + len(run))]
        n = 2 + len(bad)
        assert secrets.find_secrets(f"é {bad}{run}")[1] == [(n, 0, n + len(run))]
