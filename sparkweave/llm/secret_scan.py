"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer tells code from comments, strings, triple-quoted strings and here-documents, and
reads code into (name, value) pairs: `name = "literal"`, `name: literal`, `"a name": "literal"`,
`name => 'literal'`, `table["name"] = 'literal'`, `export NAME=bare`, `a, b = "one", "two"`, tags
(`<name>literal</name>`), keys with a block below (`name: |`).  A value is made of literals and of
names (bare, `$NAME`, `${NAME}`, also within a string), joined with `+` or side by side, in
parentheses over lines, in lists, as arguments of a call (`getenv("NAME", "literal")`) or as defaults
(`x or "literal"`).  Comparisons, setters (`setName("literal")`) and options of commands assign nothing
and are not read.  Names are constants: their literals count under every name that uses them, before or
after, over any number of steps.  Joined literals of which none is telling by
itself are judged as one and reported each.
What comments and strings hold is read too, for pairs that define no constant.  A literal is
reported if the most sensitive name it reaches and its own looks say so.  All is linear in
the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._blocks import prepare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the greedy run of [0-9a-f]+, so a shorter run never matches
KINDS = ("assign", "access", "hex", "lexed")

#: What a part of a name says about its value (fixed values); a pair of parts is written with a dash.
NAME_SCORE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "api-key": 3,
    "access-key": 3, "private-key": 3, "secret-key": 3, "auth-key": 3, "signing-key": 3, "encryption-key": 3, "client-secret": 3,
    "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "cert": 1, "salt": 1, "key": 1,
    "name": -2, "id": -1, "url": -2, "uri": -2, "path": -2, "file": -2, "length": -3, "count": -3, "type": -2, "field": -2, "expiry": -3, "ttl": -3,
}
PLACEHOLDER = re.compile(r"x{4}|\*{3}|changeme|example|placeholder|your[_-]|dummy|todo|none|null|true|false|undefined", re.I)
PLACEHOLDER_AT = re.compile(f"(?={PLACEHOLDER.pattern})", re.I)
#: A text without any part of a telling name is not read.
WORTH_LEXING = re.compile("|".join(sorted({x.split("-")[-1] for x, score in NAME_SCORE.items() if score >= 2})), re.I | re.A)
#: Possessive, so that names, blanks and literals of any length take linear time.
PAIR = re.compile(
    r"""(?:(?<![\w.-])["']?([A-Za-z_][\w.-]*+)["']?\]?|(?<![\w.-])["']([A-Za-z_][\w.\x20-]*+)["']\]?|^[\x20\t]*+(?:-\x20)?([A-Za-z_][\w.-]*+(?:\x20[\w.-]++)++)(?=:\x20))[\x20\t]*+(?::=|=>|[:=])[\x20\t]*+(?=["'`$\w+/(\[])""",
    re.M,
)
STRING = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
VARIABLE = re.compile(r"\$(?:\{([A-Za-z_]\w*+)\}|([A-Za-z_]\w*+))")
#: What begins a part that is not code; a comment sign stands at the start of a word.
OPENING = re.compile(r"""(?P<triple>\"{3}|'{3})|(?P<comment>/\*)|(?<![^\s;{}(),])(?P<line>\#|//)|<<[-~]?["']?(?P<here>[A-Za-z_]\w*+)["']?(?=[^\n]*+\n)|(?P<quote>["'`])""")
BARE = re.compile(r"[A-Za-z0-9+/_.=-]++")
#: What a bare value may go on with: all but white space, quotes and the signs that close or end it.
REST = re.compile(r"""[^\s"'`,;()\[\]{}<>|&]*+""")
CALL = re.compile(r"[A-Za-z_][\w.]*+\(")
ARGUMENT_NAME = re.compile(r"[A-Z][A-Z0-9_]*")
OR = re.compile(r"[\x20\t]++or[\x20\t]++|[\x20\t]*+(?:\|\||\?\?)[\x20\t]*+")
BLANKS, SPACES = re.compile(r"[\x20\t]*+"), re.compile(r"\s*+")
TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>]*+)</\1>")
BLOCK = re.compile(r"""^([\x20\t]*+)(?:-\x20)?["']?([A-Za-z_][\w.\x20-]*?)["']?[\x20\t]*+:[\x20\t]*+[|>][+-]?[\x20\t]*+\n((?:\1[\x20\t][^\n]*+(?:\n|\Z)|[\x20\t]*+\n)++)""", re.M)
TARGETS = re.compile(r"^[\x20\t]*+((?:[A-Za-z_][\w.]*+[\x20\t]*+,[\x20\t]*+)++[A-Za-z_][\w.]*+)[\x20\t]*+=[\x20\t]*+(?!=)", re.M)
LINE_PART = re.compile(r"\S[^\n]*")
NAME = re.compile(r"[A-Za-z_][\w.-]*+")
WORD_LINE = re.compile(r"^[\x20\t]*+(\w++)[\x20\t]*+$", re.M)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    parts = [x.lower() for x in PARTS.findall(name)]
    pairs = [f"{a}-{b}" for a, b in zip(parts, parts[1:])]
    found = [NAME_SCORE[x] for x in parts + pairs if x in NAME_SCORE]
    return max([0, *found]) + min([0, *found])


def literal_scores(text: str, starts: list[int], end: int) -> dict[int, int]:
    """Scores of the literals that end together, by start, in one pass from the last one."""
    first, seen, kinds, out, at = min(starts), set(), set(), {}, end
    held = PLACEHOLDER.search(text, first, end)
    held = held.start() if held else -1
    if held >= 0 and len(starts) > 1:
        held = max(m.start() for m in PLACEHOLDER_AT.finditer(text, first, end))
    for s in sorted(starts, reverse=True):
        new = set(text[s:at]) - seen
        seen |= new
        at = s
        for c in new:
            kinds |= {k for k, on in enumerate((c.isdigit(), c.islower(), c.isupper(), not c.isalnum(), c.isspace())) if on}
        size = end - s
        out[s] = 0 if size < 8 or 4 in kinds or held >= s else (len(kinds) >= 2) + (len(seen) >= 8) + (size >= 16)
    return out


class Lexer:
    """The pairs of a text: (name, literals as spans, names that the value uses, whether the name is a constant)."""

    def __init__(self, text: str):
        self.text, self.pairs = text, []
        self.groups: list[tuple[str, list[tuple[int, int]]]] = []  # names and literals that are joined
        self.runs = []  # bare runs (start, end): each found once, however many values end there
        self.last = {mark: text.rfind(mark) for mark in ('"""', "'''", "*/")}
        self.lines: dict[str, list[int]] | None = None  # where a line holds one word only, for here-documents
        inner: list[tuple[int, int]] = []
        self.read(0, len(text), inner)
        for a, b in inner:
            self.read(a, b, None)
        self.marked()

    def read(self, at: int, stop: int, inner: list | None) -> None:
        """Pairs from at to stop; inner gets the parts that are not code, if these are to be told apart."""
        def ahead(pattern, found):
            return found if found is None or found.start() >= at else pattern.search(self.text, at, stop)

        pair, opening = PAIR.search(self.text, at, stop), inner is not None and OPENING.search(self.text, at, stop) or None
        while at < stop:
            pair, opening = ahead(PAIR, pair), ahead(OPENING, opening)
            if opening and not (pair and pair.start() <= opening.start()):
                a, b, at = self.closed(opening, stop)
                if a < b:
                    inner.append((a, b))
            elif pair:
                at = self.value(pair[1] or pair[2] or pair[3], pair.end(), stop, inner)
            else:
                return

    def closed(self, opening: re.Match, stop: int) -> tuple[int, int, int]:
        """(start, end) of what an opening holds, and where code goes on; nothing where it is not closed."""
        text, at = self.text, opening.end()
        if mark := opening["triple"] or opening["comment"] and "*/":
            end = text.find(mark, at, stop) if self.last[mark] >= at else -1
            return (at, end, end + len(mark)) if end >= 0 else (at, at, at)
        if opening["line"]:
            end = text.find("\n", at, stop)
            return at, end if end >= 0 else stop, end if end >= 0 else stop
        if opening["here"]:
            if self.lines is None:
                self.lines = {}
                for m in WORD_LINE.finditer(text):
                    self.lines.setdefault(m[1], []).append(m.start(1))
            ends = self.lines.get(opening["here"], [])
            k = bisect.bisect(ends, at)
            return (at, ends[k], ends[k]) if k < len(ends) and ends[k] < stop else (at, at, at)
        whole = STRING.match(text, opening.start(), stop)
        return (whole.start() + 1, whole.end() - 1, whole.end()) if whole else (at, at, at)

    def value(self, name: str, at: int, stop: int, inner: list | None) -> int:
        """Read the value of a pair; where to go on: after its last string, else where it begins."""
        text, literals, uses, after = self.text, [], [], at
        group: list[tuple[int, int]] = []
        closing, call = 0, None  # brackets that are open; the call whose first argument comes next
        begun = False
        while at < stop:
            space = SPACES if closing else BLANKS
            at = space.match(text, at, stop).end() if begun else at
            string = False
            if text[at : at + 1] in ("(", "[") and at < stop:
                closing, at, begun, call = closing + 1, at + 1, True, None
                continue
            if begun and PAIR.match(text, at, stop):
                break  # another pair
            if v := STRING.match(text, at, stop):
                end = after = v.end()
                string = True
                if not (call and ARGUMENT_NAME.fullmatch(text, at + 1, end - 1)):
                    literals.append((at + 1, end - 1))
                    group.append((at + 1, end - 1))
                if v[2] is None:
                    uses += [x for pair in VARIABLE.findall(v[0]) for x in pair if x]
                if inner is not None:
                    inner.append((at + 1, end - 1))
            elif v := CALL.match(text, at, stop):
                closing, at, begun = closing + 1, v.end(), True
                call = re.search("env|get", v[0], re.I)
                continue
            elif v := VARIABLE.match(text, at, stop):
                end = v.end()
                uses.append(v[1] or v[2])
            else:
                k = bisect.bisect(self.runs, (at, len(text)))
                if k and at < self.runs[k - 1][1]:
                    end = self.runs[k - 1][1]
                elif v := BARE.match(text, at, stop):
                    end = REST.match(text, v.end(), stop).end()
                    self.runs.insert(k, (at, end))
                else:
                    break
                used = NAME.match(text, at, end)
                uses.append((used[0], at, end) if used and used.end() == end else (None, at, end))
            begun, call = True, None
            at = end
            while closing and (m := SPACES.match(text, at, stop)) and text[m.end() : m.end() + 1] in (")", "]") and m.end() < stop:
                at, closing, string = m.end() + 1, closing - 1, False
            space = SPACES if closing else BLANKS
            on = space.match(text, at, stop).end()
            if text[on : on + 1] == "+" and on < stop:
                at = space.match(text, on + 1, stop).end()
            elif string and text[on : on + 1] in ('"', "'") and on < stop and STRING.match(text, on, stop):
                at = on  # side by side
            elif (closing and text[on : on + 1] == "," and on < stop) or (m := OR.match(text, at, stop)):
                at = on + 1 if text[on : on + 1] == "," else m.end()
                self.joined(name, group)
                group = []
            else:
                break
        self.joined(name, group)
        self.pairs.append((name, literals, uses, inner is not None))
        return after

    def joined(self, name: str, group: list[tuple[int, int]]) -> None:
        if len(group) > 1:
            self.groups.append((name, group))

    def marked(self) -> None:
        """Pairs that are known by the layout around them: tags, blocks below a key, several names at once."""
        text = self.text
        for m in TAG.finditer(text) if "</" in text else ():
            a = m.start(2) + len(m[2]) - len(m[2].lstrip())
            self.pairs.append((m[1], [(a, a + len(m[2].strip()))], [], False))
        for m in BLOCK.finditer(text):
            lines = [(x.start(), x.start() + len(x[0].rstrip())) for x in LINE_PART.finditer(text, m.start(3), m.end(3))]
            self.pairs.append((m[2], lines, [], False))
            self.joined(m[2], lines)
        for m in TARGETS.finditer(text):
            at = m.end()
            for name in re.split(r"[\x20\t]*,[\x20\t]*", m[1]):
                v = STRING.match(text, at)
                end = v.end() if v else REST.match(text, at).end()
                self.pairs.append((name, [(at + 1, end - 1)] if v else [], [] if v else [(None, at, end)], False))
                comma = re.compile(r"[\x20\t]*,[\x20\t]*").match(text, end)
                if not comma:
                    break
                at = comma.end()


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    if ("=" not in text and ":" not in text and "</" not in text) or not WORTH_LEXING.search(text):
        return []
    lexer = Lexer(text)
    pairs = lexer.pairs
    constants = {name for name, _, _, constant in pairs if constant}
    held: dict[str, list[tuple[int, int]]] = {}
    uses: dict[str, list[str]] = {}
    for name, literals, used, _ in pairs:
        spans, names = held.setdefault(name, []), uses.setdefault(name, [])
        spans += literals
        for x in used:
            if isinstance(x, str):
                names.append(x)
            elif x[0] in constants and x[0] != name:
                names.append(x[0])
            elif text[x[1] - 1 : x[1]] != "+":
                spans.append(x[1:])
    reached: dict[str, int] = {}  # the most sensitive name that a name's literals reach
    for name, score in sorted(((n, name_score(n)) for n in held), key=lambda x: -x[1]):
        todo = [name]
        while todo:
            x = todo.pop()
            if x not in reached and x in held:
                reached[x] = score
                todo += uses[x]
    best: dict[tuple[int, int], int] = {}
    for name, spans in held.items():
        for s in spans:
            best[s] = max(best.get(s, 0), reached[name])
    by_end: dict[int, list[int]] = {}
    for (a, b), score in best.items():
        if score >= 2 and a < b:
            by_end.setdefault(b, []).append(a)
    found = {(a, b) for b, starts in by_end.items() for a, score in literal_scores(text, starts, b).items() if score + best[a, b] >= 4}
    for name, group in lexer.groups:
        whole = "".join(text[a:b] for a, b in group)
        if reached[name] >= 2 and found.isdisjoint(group) and literal_scores(whole, [0], len(whole))[0] + reached[name] >= 4:
            found.update((a, b) for a, b in group if a < b)
    return sorted(found)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added) spans as (start, kind, end), kind an index of KINDS."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = [(a, 3, b) for a, b in lexed(text) if not any(s <= a and b <= e for s, _, e in base)]
    return base, added


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text, in code points, end exclusive.

    Returns one row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 (of the
    base spans), spans (base and lexed ones, `kind:start:end` by start, then kind), n_lexed.
    Null text is empty; null doc_id stays null; repeated rows are scanned alike; other
    columns are ignored.
    """

    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for t in batch.column(1):
                base, added = spans_of(t.as_py() or "")
                kinds = [k for _, k, _ in base]
                for c, v in zip(list(out)[1:], (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + added)), len(added))):
                    out[c].append(v)
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
