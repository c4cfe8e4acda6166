"""Surrogates for personal data (operator 10).

Detected entities (mail addresses, telephone numbers, card and account numbers,
IP addresses, credentials, titled names) are replaced by keyed surrogates of the
same type, format and script, names also of the same gender.  One table holds
every distinct entity with its surrogate: the same entity gets the same surrogate
in all documents, and surrogates that two entities would share, or that are
somebody's real value, are drawn again until all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import arrow_rows, extended, fresh, lean, limit_arrow_rows, saved

#: Key of the surrogates; production runs pass their own.
DEFAULT_KEY = "thalweg-surrogates"
#: Rounds of drawing again; from ROOMIER on, surrogates may be longer than the original.
MAX_ROUNDS, ROOMIER = 64, 6
#: Texts that Python gets at a time.
TEXTS_AT_ONCE = 1000

# Titles by gender, and syllables by script of the names that are made up.
TITLES = {
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "Господин", "Г-н", "Κύριος"],
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "Госпожа", "Г-жа", "Κυρία"],
    "n": ["Dr.", "Prof.", "Mx."],
}
SYLLABLES = {
    "latin": ["ba", "be", "da", "do", "fa", "fi", "ga", "ha", "jo", "ka", "la", "le", "li", "ma", "mi", "na", "no", "pe", "ra", "ro", "sa", "se", "ta", "ti", "va", "vi", "wa", "we", "ya", "zo"],
    "cyrillic": ["ба", "ве", "га", "да", "же", "за", "ки", "ла", "ми", "на", "ор", "пе", "ра", "са", "ти", "фе", "хо", "че", "ша", "ян"],
    "greek": ["βα", "γα", "δε", "ζη", "θα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τε", "φι", "χα"],
}
ENDINGS = {
    "latin": {"m": "n", "f": "a", "n": "r"},
    "cyrillic": {"m": "н", "f": "на", "n": "р"},
    "greek": {"m": "ς", "f": "η", "n": "ρ"},
}

_TITLE = "|".join(re.escape(t) for t in sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'](?!s\b)[^\W\d_]+)?"
_MENTION, _AFTER = re.compile(rf"(?<!\w){_NAME}(?!\w)"), re.compile(rf"[ \t]+({_NAME})")
#: Seven digits, or four and three separators, are the least that cards, numbers and IPv4 addresses have.
_DIGITS = r"[0-9][0-9 .()-]{5,}[0-9]"
#: First parts of keys, and words that announce a secret.
_STARTS = "ghp|gho|ghs|glpat|xox[abp]|sk"
_KEYS = rf"(?:{_STARTS})[-_]"
_SECRETS = r"token|secret|password|passwd|api[_-]?key|access[_-]?key"
#: (kind, pattern, hint): the hint, for Java, matches in every text in which the pattern
#: finds a valid entity with ASCII digits.  All hints begin with one of FIRST, which is
#: tried before them; the words of secrets don't and are looked for apart.
PATTERNS = [
    ("email", r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "@"),
    ("secret", rf"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])|(?<![A-Za-z0-9]){_KEYS}[A-Za-z0-9_-]{{16,}}", rf"AKIA|ASIA|(?<={_STARTS})[-_]"),
    ("secret", rf"(?i:(?<![A-Za-z])(?:{_SECRETS})[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<value>[A-Za-z0-9+/_-]{{16,}}={{0,2}})", None),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)", _DIGITS),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _DIGITS),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _DIGITS),
    ("ipv6", r"(?<![\w:])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]*(?:[0-9A-Fa-f]|::)(?!\w|:\w|::)", ":[0-9A-Fa-f]{0,4}:"),
    ("phone", r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(\d{1,5}\)|[ .-]?\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?![\w])|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])", _DIGITS),
    ("name", rf"(?<!\w)(?P<title>{_TITLE})[ \t]+(?P<name>{_NAME}(?:[ \t]+{_NAME}){{0,2}})", _TITLE),
]
_ALL = [(kind, re.compile(p)) for kind, p, _ in PATTERNS]
FIRST = "[@0-9A-ZГΚ:_-]"
HINT = f"(?={FIRST})(?:" + "|".join(dict.fromkeys(h for _, _, h in PATTERNS if h)) + ")"
#: Digits other than ASCII, and characters that Java doesn't know yet.
_OTHER_DIGITS = r"[\p{Nd}\p{Cn}&&[^\x00-\x7F]]"


def may_hold(text) -> F.Column:
    """What a text must hold, at least, to have an entity: for leaving most texts alone
    cheaply.  True for every text in which ``find`` finds something, false for null."""
    c = F.col(text)
    secret = (F.contains(c, F.lit("=")) | F.contains(c, F.lit(":"))) & c.rlike(rf"(?iu:{_SECRETS})")
    return F.coalesce(c.rlike(HINT) | secret | c.rlike(_OTHER_DIGITS), F.lit(False))


def _luhn(digits: str) -> bool:
    return _luhn_digit(digits[:-1]) == digits[-1]


def _luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return len(digits) >= 13 and _luhn(digits)
    if kind == "iban":
        return _mod97(value.replace(" ", "")) == 1
    if kind in ("ipv4", "ipv6"):
        try:
            address = ipaddress.ip_address(value)
        except ValueError:
            return False
        return kind == "ipv4" or not address.is_unspecified  # "::" alone is nobody's
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    return True


def _ascii(value: str) -> str:
    return "".join(str(int(c)) if c.isdecimal() else c for c in value)


def _key(kind: str, value: str) -> str:
    """What an entity is known by, however it is written.  Telephone numbers without
    a country code have the form of those of country 1."""
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", _ascii(value))
        return digits if kind != "phone" else f"+{digits}" if value[0] == "+" else f"+1{digits}"
    if kind == "iban":
        return _ascii(value).replace(" ", "")
    if kind == "ipv6":
        return str(ipaddress.ip_address(value))
    return value.lower() if kind == "email" else value


class _Spans:
    """Spans of a text that don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _mentions(text: str, named: list[tuple[int, int, str, str]], taken: _Spans) -> Iterator[tuple[int, int, str, str]]:
    """Occurrences, outside of ``taken``, of words of the names found in the text.  A
    word that is both a given and a last name is given if another name follows; of
    several genders the nearest one before counts, or else the first."""
    known: dict[str, list[tuple[int, str]]] = {}
    for a, _, kind, word in sorted(named):
        known.setdefault(word, []).append((a, kind))
    for m in _MENTION.finditer(text):
        whole = m[0].casefold() in known
        for w in [m] if whole else re.finditer(r"[^-']+", m[0]):
            a, b = (w.start() + (not whole) * m.start(), w.end() + (not whole) * m.start())
            uses = known.get(text[a:b].casefold())
            if not uses or taken.meets(a, b):
                continue
            after = _AFTER.match(text, b)
            given = bool(after) and after[1].casefold() in known
            uses = [u for u in uses if (u[1] != "name") == given] or uses
            before = bisect_left(uses, a, key=lambda u: u[0])
            kind = uses[max(0, before - 1)][1]
            yield a, b, kind, text[a:b].casefold()


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of a text's entities, in order and apart.  Of
    overlapping ones the kind listed first wins.  Names come word by word, as
    ``name:<gender>`` for given names and ``name`` for the last word of a name,
    so that a person is the same one whether or not the given name is there, and once
    found with a title are also found without.  Keys leave out how numbers are written."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = _Spans()
    for kind, pattern in _ALL:
        for m in pattern.finditer(text):
            if kind == "name":
                gender = next(g for g, ts in TITLES.items() if m["title"] in ts)
                words = [(m.start("name") + w.start(), m.start("name") + w.end(), w[0]) for w in re.finditer(r"[^ \t]+", m["name"])]
                spans = [(a, b, f"name:{gender}" if k < len(words) - 1 else "name", w.casefold()) for k, (a, b, w) in enumerate(words)]
            else:
                a, b = m.span("value") if "value" in pattern.groupindex else m.span()
                if not _valid(kind, text[a:b]):
                    continue
                spans = [(a, b, kind, _key(kind, text[a:b]))]
            a, b = spans[0][0], spans[-1][1]
            if not taken.meets(a, b):
                taken.add(a, b)
                out += spans
    if named := [f for f in out if f[2].startswith("name")]:
        out += _mentions(text, named, taken)
    return sorted(out)


class _Stream:
    """Keyed random numbers for one entity and draw."""

    def __init__(self, key: str, *of: str) -> None:
        self.seed, self.n, self.left = hmac.new(key.encode(), "\0".join(of).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 6:
            self.left += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        v, self.left = int.from_bytes(self.left[:6], "big"), self.left[6:]
        return v % n

    def like(self, value: str) -> str:
        """Digits for digits, letters for letters of the same case; the rest stays."""
        out = []
        for c in value:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            elif c.isalpha():
                out.append(self.letter(c))
            else:
                out.append(c)
        return "".join(out)

    def letter(self, c: str) -> str:
        script = _script(c)
        pool = sorted({x for s in SYLLABLES[script] for x in s})
        x = pool[self.below(len(pool))]
        return x.upper() if c.isupper() else x


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in word) else "latin"


#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def surrogate(key: str, kind: str, value: str, draw: int = 0) -> str:
    """The surrogate of an entity (its key as ``find`` gives it) in the given draw."""
    r = _Stream(key, kind, value, str(draw))
    extra = max(0, draw - ROOMIER + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        top = domain.rpartition(".")[2]
        return r.like(local + "x" * extra) + "@" + r.like(domain[: -len(top) - 1]) + "." + top
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = digits[0] + "".join(str(r.below(10)) for _ in digits[1:-1])
        new = iter(body + _luhn_digit(body))
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "iban":
        plain = value.replace(" ", "")
        body = r.like(plain[4:])
        check = 98 - _mod97(plain[:2] + "00" + body)
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "ipv4":
        private = ipaddress.ip_address(value).is_private
        return ".".join(["10"] * private + [str(1 + r.below(223))] * (not private) + [str(r.below(256)) for _ in range(3)])
    if kind == "ipv6":
        lead = ["fe80", "0", "0", "0"] if ipaddress.ip_address(value).is_link_local else []
        return str(ipaddress.ip_address(":".join([*lead, *(f"{r.below(1 << 16):x}" for _ in range(8 - len(lead)))])))
    if kind == "phone":
        lead = _COUNTRY.match(value)
        head = lead[0] if lead else ""
        return head + r.like(value[len(head) :])
    if kind == "secret":
        lead = re.match(rf"AKIA|ASIA|{_KEYS}", value)
        head = lead[0] if lead else ""
        rest = value[len(head) :]
        if re.fullmatch(r"[0-9a-f]+", rest):
            return head + "".join("0123456789abcdef"[r.below(16)] for _ in rest)
        return head + r.like(rest)
    if kind == "ssn":
        return r.like(value)
    script, gender = _script(value), kind.partition(":")[2]
    syllables = SYLLABLES[script]
    n = max(2, min(6, len(value) // 2)) + extra
    word = "".join(syllables[r.below(len(syllables))] for _ in range(n)) + (ENDINGS[script][gender] if gender else "")
    return word


def assign(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): surrogates are distinct
    within a kind and none is itself a value of that kind."""
    made = "kind string, value string, surrogate string"

    def drawing(draw: int):
        def run(batches):
            for batch in batches:
                kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [surrogate(key, k, v, draw) for k, v in zip(kinds, values, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["kind", "value", "surrogate"])

        return run

    entities = entities.select("kind", "value")
    todo, done = entities, None
    for draw in range(MAX_ROUNDS):
        tried = saved(todo.mapInArrow(drawing(draw), made), "surrogates")
        # of those that drew the same the smallest value keeps it, unless it is taken or real
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))
        free = tried.join(entities.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = saved(free.withColumn("_k", first).where("_k = 1").select("kind", "value", "surrogate"), "kept")
        done = kept if done is None else done.unionByName(kept)
        todo = saved(todo.join(kept, ["kind", "value"], "left_anti"), "again")
        if todo.isEmpty():
            return done
    raise RuntimeError("no distinct surrogates were found")


def _laid(was: str, new: str) -> str:
    """The letters and digits of ``new``, the last ones if there are more, in the
    places and the kind of digits of ``was``."""
    chars = iter([c for c in new if c.isalnum()][-sum(c.isalnum() for c in was) :])
    return "".join((chr(ord(c) - int(c) + int(x)) if c.isdecimal() else x) if c.isalnum() and (x := next(chars)) else c for c in was)


def _replace(text: str, found: list[tuple[int, int, str, str]], of: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for a, b, kind, value in found:
        new = of[kind, value]
        if kind.startswith("name"):
            new = new.upper() if text[a:b].isupper() else new.capitalize()
        elif kind in ("card", "iban", "phone", "ssn"):
            new = _laid(text[a:b], new)
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """``docs`` with surrogates for entities in ``text``, and n_entities in place of
    a column of that name.  Texts without entities, null and empty ones included,
    come back as they are with n_entities 0; repeated rows are all returned.

    Only texts that may hold an entity (see ``may_hold``) leave their place.  No rows
    give no rows; long texts are searched whole.
    """
    limit_arrow_rows(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c.lower() != "n_entities"])
    names, at = docs.columns, docs.columns.index(text)
    hint = may_hold(text)
    row, spans, of_row = fresh([*names, "n_entities"], "row", "found", "of")
    entity = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())])

    @lean
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip("ab", f[:2], strict=True), kind=f[2], value=f[3]) for f in find(t.as_py())] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(entity))], [*names, spans])

    schema = extended(docs.schema, f"`{spans}` array<struct<a:int,b:int,kind:string,value:string>>")
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        held = saved(docs.where(hint).mapInArrow(detect, schema).withColumn(row, F.monotonically_increasing_id()), "entities")
    each = held.select(row, F.explode(spans).alias("f")).select(row, "f.kind", "f.value").distinct()
    entities = saved(each.select("kind", "value").distinct(), "distinct-entities")
    table = assign(entities, key)
    pairs = each.join(table, ["kind", "value"]).groupBy(row).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(of_row))
    joined = held.join(pairs, row, "left")

    @lean
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for t, found, of in zip(batch.column(at), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                found = [(f["a"], f["b"], f["kind"], f["value"]) for f in found or []]
                texts.append(_replace(t.as_py(), found, {(x["kind"], x["value"]): x["surrogate"] for x in of}) if found else t.as_py())
                n.append(len(found))
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], [*names, "n_entities"])

    changed = joined.select(*names, spans, of_row).mapInArrow(replace, extended(docs.schema, "n_entities int"))
    return docs.where(~hint).withColumn("n_entities", F.lit(0)).unionByName(changed)
