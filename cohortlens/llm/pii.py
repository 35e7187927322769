"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, plus signs before a digit, digit
pairs (joined by nothing, a dot, a space or a hyphen), URL schemes and identifier cue words. A small deterministic
parser for each anchor then expands to the span's boundaries and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from cohortlens.llm.common import map_columns, per_task

# The cue words that stand before an account or identity number, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "konto", "compte", "cuenta")
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("userinfo", "iban", "account")
KINDS = BASE_KINDS + EXTRA_KINDS

_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
_ACCOUNT_GAP = re.compile(r"(?: (?:no|number|nr|nummer))?[ .:#=]{1,4}", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def anchors():
    """The automaton: anchor text -> (kind of parser, length)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    digits = "0123456789"
    automaton.add_word("@", ("at", 1))
    automaton.add_word("://", ("scheme", 3))
    for a in digits:
        automaton.add_word("+" + a, ("plus", 2))
        for b in digits:
            automaton.add_word(a + "." + b, ("dot", 3))
            for joint in ("", " ", "-"):
                automaton.add_word(a + joint + b, ("digits", 2 + len(joint)))
    for cue in ACCOUNT_CUES:
        automaton.add_word(cue, ("cue", len(cue)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def run_start(text: str, at: int, floor: int) -> int:
    """Start of the digit run that holds position ``at``."""
    while at > floor and "0" <= text[at - 1] <= "9":
        at -= 1
    return at


def expand_email(text: str, at: int, floor: int):
    """The address around the at-sign ``at``, not reaching before ``floor``: (start, end) or None."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def chain_start(text: str, at: int, floor: int) -> int:
    """Start of the chain of digits with single spaces or hyphens that holds ``at``."""
    while True:
        at = run_start(text, at, floor)
        if at - 2 >= floor and text[at - 1] in " -" and "0" <= text[at - 2] <= "9":
            at -= 2
        else:
            return at


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def scan(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points; those of one kind do not overlap."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last candidate of a kind ended
    for end, (kind, length) in automaton.iter(lowered(text)):
        first = end - length + 1
        if kind == "at":
            if got := expand_email(text, first, done["email"]):
                spans.append(("email", *got))
                done["email"] = got[1]
        elif kind == "plus":
            if m := _PHONE.match(text, first):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
        elif kind == "dot":
            if first >= done["ip"]:
                m = _DOTTED.match(text, run_start(text, first, 0))
                parts = [(p.start(), p.end()) for p in re.finditer("[0-9]+", m[0])]
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i:i + 4]
                    if all(e - s <= 3 or not m[0][s:e - 3].strip("0") for s, e in four) and all(int(m[0][max(s, e - 3):e]) <= 255 for s, e in four):
                        spans.append(("ip", m.start() + four[0][0], m.start() + four[3][1]))
                done["ip"] = m.end()
        elif kind == "digits":
            if first >= done["card"]:
                m = _CHAIN.match(text, chain_start(text, first, 0))
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
                done["card"] = m.end()
        elif kind == "scheme":
            if m := _USERINFO.match(text, end + 1):
                spans.append(("userinfo", *m.span()))
        elif end + 1 < len(text) and end + 1 >= done["account"] and not (first and text[first - 1].isalnum()):
            if gap := _ACCOUNT_GAP.match(text, end + 1):
                iban = _IBAN.match(text, gap.end())
                while iban and not iban_ok(iban[0]):  # a word after the number may have been taken in
                    cut = iban[0].rfind(" ")
                    iban = _IBAN.fullmatch(text, gap.end(), gap.end() + cut) if cut > 0 else None
                number = None if iban else _ACCOUNT.match(text, gap.end())
                if iban or number:
                    spans.append(("iban" if iban else "account", *(iban or number).span()))
                    done["account"] = spans[-1][2]
    return spans


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end), masked text and digest columns for each document.

    Needs doc_id and text; a null text counts as empty and stays null when masked. Positions are code points, the end
    exclusive. Spans of one kind do not overlap; spans of different kinds may, and are masked as one. Repeated rows
    each get a row.
    """

    @per_task
    def make():
        from hashlib import sha256

        automaton = anchors()

        def step(rows):
            out = {k: [] for k in ("spans", "masked", "base_sha256", "span_list", *BASE_KINDS)}
            for text in rows["text"]:
                spans = scan(text, automaton) if text else []
                out["spans"].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                out["masked"].append(mask(text, spans) if spans else text)
                base = joined([x for x in spans if x[0] in BASE_KINDS])
                out["base_sha256"].append(sha256(base.encode()).hexdigest())
                out["span_list"].append(joined(spans))
                for k in BASE_KINDS:
                    out[k].append(sum(x[0] == k for x in spans))
            return {"doc_id": rows["doc_id"]} | {f"n_{k}" if k in BASE_KINDS else k: v for k, v in out.items()}

        return step

    return map_columns(docs.select("doc_id", "text"), make,
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                       "span_list string, spans array<struct<kind:string,start:long,end:long>>, masked string")


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, but text masked and n_chars (where there is one) counted anew."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        automaton = anchors()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, min(1024, batch.num_rows - lo))
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                texts = cols["text"].to_pylist()
                clean = [mask(t, s) if t and (s := scan(t, automaton)) else t for t in texts]
                changed = [a is not b for a, b in zip(texts, clean)]
                if any(changed):
                    cols["text"] = pa.array(clean, cols["text"].type)
                    if "n_chars" in names:
                        was = cols["n_chars"].to_pylist()
                        cols["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(clean, changed, was)], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules by plain regular expressions: the reference that tests hold ``scan`` against."""
    rules: list[tuple[str, str, Callable[[str], bool]]] = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]
