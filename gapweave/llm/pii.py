"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, scheme marks, digit pairs and identifier cues in one
pass; at each anchor a deterministic parser expands to the boundaries and validates.  Texts are
never scanned by a backtracking expression, and a run of characters is expanded once.
"""

from __future__ import annotations

import functools
import hashlib
import string

from pyspark.sql import DataFrame

from gapweave.llm.common import change_texts, map_rows, table

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "ssn")
N_BASE = 4
DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | {"-"}
PHONE = DIGITS | frozenset(" ().-")
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "cuenta": "account",
    "compte": "account",
    "ssn": "ssn",
    "social security": "ssn",
}


@functools.cache
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 0))
    for x in string.digits:
        a.add_word("+" + x, ("phone", 1))
        for y in string.digits:
            a.add_word(x + "." + y, ("ip", 2))
            for sep in ("", " ", "-"):
                a.add_word(x + sep + y, ("card", len(sep) + 1))
    for mark in ("://", "mailto:", "tel:"):
        a.add_word(mark, ("url", len(mark) - 1))
    for cue in CUES:
        a.add_word(cue, (CUES[cue], 0))
    a.make_automaton()
    return a


def lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _email(t: str, at: int, floor: int):
    """The address around the at-sign, not reaching before ``floor``."""
    s = at
    while s > floor and t[s - 1] in LOCAL:
        s -= 1
    if s == at:
        return None
    n, e, labels = len(t), at + 1, 0
    while True:
        b = e
        while e < n and t[e] in LABEL:
            e += 1
        if e == b:
            e = b - 1  # the dot before an empty label isn't part of it
            break
        labels += 1
        if e < n and t[e] == ".":
            e += 1
            continue
        break
    return (s, e) if labels >= 2 else None


def _chain(t: str, i: int, j: int, seps: str):
    """The longest run of digits around t[i:j+1], each pair parted by at most one separator."""
    n = len(t)
    while i > 0:
        if t[i - 1] in DIGITS:
            i -= 1
        elif i > 1 and t[i - 1] in seps and t[i - 2] in DIGITS:
            i -= 2
        else:
            break
    j += 1
    while j < n:
        if t[j] in DIGITS:
            j += 1
        elif j + 1 < n and t[j] in seps and t[j + 1] in DIGITS:
            j += 2
        else:
            break
    return i, j


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _ips(t: str, s: int, e: int):
    """Groups of four in a chain of numbers parted by dots."""
    parts, at = t[s:e].split("."), s
    starts = []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
            yield starts[k], starts[k + 3] + len(four[3])


def _phone(t: str, plus: int):
    """(end of what is consumed, valid) of the number at a plus and digit."""
    n, e = len(t), plus + 2
    while e < n and t[e] in PHONE:
        e += 1
    while e > plus + 2 and t[e - 1] not in DIGITS:
        e -= 1
    if e < plus + 4:
        return None, False
    return e, 8 <= sum(c in DIGITS for c in t[plus:e]) <= 15


URL_END = frozenset(string.whitespace) | frozenset("<>\"'`{}|\\^")


class Run:
    """What the URL anchors of one run of characters ask for, found once for the run."""

    def __init__(self, t: str, e: int):
        end = e
        while end < len(t) and t[end] not in URL_END:
            end += 1
        self.end, cut = end, end
        while cut > e and t[cut - 1] in ".,;:!?)]":
            cut -= 1
        self.cut = cut
        self.last_at = t.rfind("@", e, cut)
        self.sixth_digit, digits = -1, 0  # from the end
        for i in range(cut - 1, e - 1, -1):
            digits += t[i] in DIGITS
            if digits == 6:
                self.sixth_digit = i
                break


def _url(t: str, s: int, e: int, run: Run):
    """A URL that carries personal data: user info before the host, or a mailto or tel address."""
    mark = t[s:e].lower()
    if mark == "://":
        while s > 0 and (t[s - 1] in ALNUM or t[s - 1] in "+.-"):
            s -= 1
        while s < e and not t[s].isalpha():
            s += 1
    elif s > 0 and t[s - 1] in ALNUM:
        return None
    end = max(e, run.cut)
    if mark == "mailto:":
        ok = run.last_at >= e
    elif mark == "tel:":
        ok = run.sixth_digit >= e
    else:
        slash = t.find("/", e, end)
        ok = t[s : s + 1].isalpha() and t.find("@", e, end if slash < 0 else slash) >= 0
    return (s, end) if ok else None


def _after_cue(t: str, e: int) -> int:
    """Skips what may stand between a cue and its number."""
    low = t[e : e + 24].lower()
    k = 0
    for word in (" number", " no.", " no", " nr.", " nr", " num", "#"):
        if low.startswith(word):
            k = len(word)
            break
    while k < len(low) and low[k] in " :#=":
        k += 1
    return e + k


def _iban(t: str, e: int):
    s = _after_cue(t, e)
    k, chars = s, []
    while k < len(t) and len(chars) < 35:
        if t[k] in ALNUM and t[k].isascii():
            chars.append(t[k].upper())
        elif not (t[k] == " " and k + 1 < len(t) and t[k + 1] in ALNUM):
            break
        k += 1
        c = "".join(chars)
        if len(c) >= 15 and (k == len(t) or t[k] not in ALNUM) and c[:2].isalpha() and c[2:4].isdigit() and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1:
            return s, k
    return None


def _account(t: str, e: int):
    s = _after_cue(t, e)
    k = s
    while k < len(t) and (t[k] in DIGITS or t[k] == "-" and k > s):
        k += 1
    while k > s and t[k - 1] == "-":
        k -= 1
    return (s, k) if s > e and 6 <= sum(c in DIGITS for c in t[s:k]) <= 17 else None


def _ssn(t: str, e: int):
    s = _after_cue(t, e)
    x = t[s : s + 11]
    ok = len(x) == 11 and all((c in DIGITS) if k not in (3, 6) else c in "- " for k, c in enumerate(x)) and not (t[s + 11 : s + 12] in DIGITS and t[s + 11 : s + 12])
    return (s, s + 11) if ok and x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000" else None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points; kinds as in KINDS.  A null or empty
    text has none.  The steps grow with the length of the text alone, however many anchors a run has."""
    t = text or ""
    run = None
    out: set[tuple[int, int, int]] = set()
    done = [0] * len(KINDS)
    for last, (kind, back) in _anchors().iter(lower_same_length(t)):
        k = KINDS.index(kind)
        i = last - back
        if kind == "card":
            if i < done[2]:
                continue
            s, e = _chain(t, i, last, " -")
            done[2] = e
            digits = "".join(c for c in t[s:e] if c in DIGITS) if e - s < 64 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.add((k, s, e))
        elif kind == "ip":
            if i < done[1]:
                continue
            s, e = _chain(t, i, last, ".")
            done[1] = e
            out |= {(k, a, b) for a, b in _ips(t, s, e)}
        elif kind == "email":
            if i >= done[0] and (x := _email(t, i, done[0])):
                done[0] = x[1]
                out.add((k, *x))
        elif kind == "phone":
            if i >= done[3]:
                e, ok = _phone(t, i)
                if e:
                    done[3] = e
                    if ok:
                        out.add((k, i, e))
        else:
            if kind == "url" and i < done[k]:
                continue
            if kind == "url" and (run is None or last + 1 > run.end):
                run = Run(t, last + 1)
            x = _url(t, i, last + 1, run) if kind == "url" else {"iban": _iban, "account": _account, "ssn": _ssn}[kind](t, last + 1)
            if x and x[0] >= done[k]:
                done[k] = x[1]
                out.add((k, *x))
    return sorted(out)


def redact(text: str | None) -> str | None:
    """Puts a mark like ``<EMAIL>`` in the place of each span; overlapping spans share the mark of the
    one that starts first."""
    spans = sorted((s, -e, k) for k, s, e in find(text))
    if not spans:
        return text
    parts, at = [], 0
    for s, e, k in spans:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, -e)
    return "".join([*parts, text[at:]])


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row, repeated ones too; none
    is moved.  Null and empty texts have no spans, an empty table has no rows, other columns are not read."""

    def rows(batch):
        out = []
        for doc_id, text in batch:
            found = find(text)
            base = [x for x in found if x[0] < N_BASE]
            n = [sum(x[0] == k for x in base) for k in range(N_BASE)]
            out.append((doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        return out

    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with redacted texts, all columns kept in order."""
    return change_texts(docs, redact)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
