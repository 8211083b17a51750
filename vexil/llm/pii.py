"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass over the text;
a local parser at each anchor expands to both sides, fixes the boundary and validates.

Every parser looks only at the run of characters that its anchor stands in, and each run is looked at once a kind, so the time follows the length of the text
even for one very long word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import lower_str, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://")
#: Cues in lower case; they are found in any case.
ACCOUNT_CUES = ("iban", "ssn", "social security", "account", "acct", "passport", "tax id", "tax_id", "customer id", "member id", "national id")
SECRET_CUES = ("password", "passwd", "api_key", "api key", "api-key", "apikey", "access_key", "access key", "secret_key", "secret key", "private key", "token", "secret")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_URL = re.compile(r"[^\x00-\x20\"'<>\\^`{|}]+")
_IDENTIFIER = re.compile(r"(?:\s?(?:number|Number|NUMBER|no\.?|No\.?|nr\.?|Nr\.?|#))?\s?[:=#]?\s?([A-Z]{0,3}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9+/_.-]{8,})")

Span = tuple[int, int, int]


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def iban(value: str) -> bool:
    """Two letters, two check digits, 15 to 34 characters in all without blanks, and a remainder of 1 by 97."""
    bare = value.replace(" ", "").replace("-", "")
    if not (15 <= len(bare) <= 34 and bare.isascii() and bare[:2].isalpha() and bare[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _account(cue: str, value: str) -> bool:
    """Whether what stands behind a cue is well-formed: after `iban`, and for whatever looks like one, the check digits must hold; a social security number has nine digits
    in ranges that are given out."""
    if cue == "iban" or (len(value) >= 15 and _IBAN.fullmatch(value)):
        return iban(value)
    if cue in ("ssn", "social security"):
        digits = value.replace(" ", "").replace("-", "")
        return len(digits) == 9 and digits.isdigit() and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    return True


def scan(text: str) -> list[Span]:
    """Spans (start, kind's place in KINDS, end) in code points, in that order.

    The four base kinds are exactly the leftmost non-overlapping matches of their patterns that pass validation; a match that fails is dropped, and what it
    covers isn't tried again. Added kinds: urls after a scheme; account numbers, which are IBANs whose check digits hold, with or without a cue, and other identifiers
    with a digit after a cue; values after a secret's cue and = or :. Cues count in any case.
    """
    found: list[Span] = []
    ends = dict.fromkeys(KINDS, 0)
    run_end = 0
    lower = lower_str(text)
    for last, (anchor, size) in _ANCHORS.iter(lower):
        at = last - size + 1
        if anchor == "digit":
            if at < run_end:
                continue
            run_end = _RUN.match(text, at).end()
            if at - 2 >= ends["account"] and "A" <= text[at - 1] <= "Z" and (at == 2 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and iban(m[0]):
                ends["account"] = m.end()
                found.append((at - 2, 5, m.end()))
            if at >= ends["ip"] and (m := _IP.match(text, at)):
                ends["ip"] = m.end()
                if all(map(_small, m[0].split("."))):
                    found.append((at, 1, m.end()))
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        elif anchor == "at":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                found.append((start, 0, m.end()))
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif at >= ends[anchor] and anchor == "url":
            if (m := _URL.match(text, last + 1)) and any(c.isalnum() for c in m[0]):
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                ends["url"] = end
                found.append((at, 4, end))
        elif at >= ends[anchor] and (at == 0 or not text[at - 1].isalnum()):
            m = (_IDENTIFIER if anchor == "account" else _SECRET).match(text, last + 1)
            if m and (anchor == "secret" or (m.start(1) >= ends["account"] and _account(lower[at : last + 1], m[1]))):
                ends[anchor] = m.end(1)
                found.append((m.start(1), KINDS.index(anchor), m.end(1)))
    found.sort()
    return found


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            spans = scan(text or "")
            base = [x for x in spans if x[1] < len(BASE)]
            rows.append((*(sum(x[1] == k for x in base) for k in range(len(BASE))), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        yield out.assign(doc_id=pdf["doc_id"].values)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs(doc_id, text); no shuffle.

    A null or empty text has no spans and the digest of the empty string; null and repeated doc_ids pass through; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInPandas(_run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "<{}>") -> str | None:
    """text with each span replaced by its kind; of overlapping spans the first stays."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in scan(text):
        if s >= at:
            out += [text[at:s], mask.format(KINDS[k])]
            at = e
    return "".join([*out, text[at:]])
