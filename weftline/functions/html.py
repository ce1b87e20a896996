"""Plain text of web pages: a vectorised function over the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that break a line, and elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SKIPPED = frozenset("script style noscript template head title iframe svg".split())
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED and tag != "title" and tag != "head":
            self.skip += 1
        elif tag in ("head", "title"):
            self.skip += tag == "title"
        elif tag in BLOCKS:
            self.out.append("\n• " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED and tag != "head":
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def plain_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    rows = (re.sub(r" +", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in rows if x and x != "•")


def decode_detect(payload: bytes) -> str:
    """Detect the charset first: a byte-order mark, the declared one, UTF-8, else windows-1252. A failure gives ''."""
    try:
        if payload.startswith(b"\xef\xbb\xbf"):
            return payload[3:].decode("utf-8")
        m = _CHARSET.search(payload[:2048])
        for name in [m[1].decode("ascii")] if m else []:
            try:
                return payload.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
        try:
            return payload.decode("utf-8")
        except UnicodeDecodeError:
            return payload.decode("windows-1252", "replace")
    except Exception:
        return ""


def decode_utf8_first(payload: bytes) -> str:
    try:
        return payload.decode("utf-8")
    except UnicodeDecodeError:
        return decode_detect(payload)


def _extractor(decode):
    @F.pandas_udf(StringType())
    def extract(payloads: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return plain_text(decode(bytes(b)))
            except Exception:
                return ""

        return payloads.map(one)

    return extract


extract_detect = _extractor(decode_detect)
extract_utf8_first = _extractor(decode_utf8_first)
