"""Secret scans: the regexes of all rules are compiled by subset construction and minimisation into one transition array, and
every text is read by it once, byte by byte.

The automaton is that of ".*(rule 1|rule 2|...)": after a byte its state tells which rules have a match that ends there. At
such an event that lies behind the rule's last match, the reversed rule's automaton gives the leftmost start and the rule's
own automaton the longest end, so that each rule has its leftmost-longest matches without overlaps, as if it ran alone. This
holds for rules in which a match that starts further left also begins to accept no later, which all rules below fulfil.
Where all that ends at an event starts within the rule's last match, the rule alone is searched from the end of that match up
to its next one, and events before are passed over. So each rule reads each byte a bounded number of times: time is linear in
the text, and memory is that of the text and its matches.

Rules are over ASCII; other bytes of UTF-8 only occur in negated classes. Defined cases: a null or empty text has no spans;
repeated rows and ids are scanned as they are; an empty table gives an empty result; spans that start together are in the
order of their rules; columns of docs other than those named are ignored by scan() and kept by redact(), whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, with_fields

#: A private key from its BEGIN to its END line, with the header lines of encrypted ones; the BEGIN line alone where no END follows.
_PEM = (
    r"-----BEGIN\x20(RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----"
    r"([\r\n\t\x20]*(Proc-Type:\x20[0-9]+,ENCRYPTED[\r\n\t\x20]+DEK-Info:\x20[A-Z0-9-]+,[0-9A-Fa-f]+)?"
    r"[A-Za-z0-9+/=\r\n\t\x20\\]*-----END\x20(RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----)?"
)
#: Rules in order: kind, regex, fewest characters of the whole match, fewest of the part behind the last [:=] and quote.
#: The first three are the base kinds, the rest the method's own.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("pem", _PEM, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 24, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0),
]
BASE_KINDS = ("assign", "access", "hex")


# --- regex -> tree. Nodes: ("set", frozenset of bytes), ("cat", [..]), ("or", [..]), ("rep", node, least, most or None)
class _Parser:
    def __init__(self, regex: str):
        self.s, self.k, self.fold = regex, 0, False

    def peek(self) -> str:
        return self.s[self.k : self.k + 1]

    def take(self) -> str:
        self.k += 1
        return self.s[self.k - 1]

    def either(self):
        ways = [self.sequence()]
        while self.peek() == "|":
            self.take()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", ways)

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while self.peek() and self.peek() in "?*+{":
                c = self.take()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
                if c == "{":
                    end = self.s.index("}", self.k)
                    a, comma, b = self.s[self.k : end].partition(",")
                    low, high, self.k = int(a), (int(b) if b else None) if comma else int(a), end + 1
                node = ("rep", node, low, high)
            out.append(node)
        return ("cat", out)

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.k += 2
            return int(self.s[self.k - 2 : self.k], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def one(self, of: set[int]):
        if self.fold:
            of |= {b ^ 32 for b in of if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(of))

    def atom(self):
        if self.peek() == "(":
            self.take()
            before = self.fold
            if self.s.startswith("?i:", self.k):
                self.k, self.fold = self.k + 3, True
            elif self.s.startswith("?:", self.k):
                self.k += 2
            node = self.either()
            self.take()
            self.fold = before
            return node
        if self.peek() != "[":
            return self.one({self.byte()})
        self.take()
        negated = self.peek() == "^" and bool(self.take())
        of: set[int] = set()
        while self.peek() != "]":
            a = self.byte()
            if self.peek() == "-" and self.s[self.k + 1] != "]":
                self.take()
                of |= set(range(a, self.byte() + 1))
            else:
                of.add(a)
        self.take()
        return self.one(set(range(256)) - of if negated else of)


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def add(self, node, start: int) -> int:
        """The state that node's matches from `start` end in."""
        if node[0] == "set":
            end = self.state()
            self.step[start] = (node[1], end)
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, self.fresh(start))
            return start
        if node[0] == "or":
            end = self.state()
            for x in node[1]:
                self.empty[self.add(x, self.fresh(start))].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, self.fresh(start))
        if high is None:
            loop = self.fresh(start)
            self.empty[self.add(inner, self.fresh(loop))].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(inner, self.fresh(start))
        self.empty[start].append(end)
        return end

    def fresh(self, after: int) -> int:
        s = self.state()
        self.empty[after].append(s)
        return s


class Dfa:
    """A minimal automaton over byte classes. step[s + classes[byte]] is the next state (states are multiples of the number of
    classes), accepts[s] the indices of the rules with a match that ends; state 0 starts, `dead` never accepts again (-1: none)."""

    def __init__(self, trees: list, searching: bool):
        nfa = _Nfa()
        start = nfa.state()
        ends = [nfa.add(t, nfa.fresh(start)) for t in trees]

        def closed(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        sets = sorted({x[0] for x in nfa.step if x}, key=sorted)
        signature: dict[tuple, int] = {}
        self.classes = bytes(signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256))
        width = len(signature)
        of_class = [self.classes.index(c) for c in range(width)]
        first = closed({start})
        number, order, table = {first: 0}, [first], []
        for states in order:  # grows while it is read
            row = []
            for b in of_class:
                to = closed({x[1] for s in states if (x := nfa.step[s]) and b in x[0]} | ({start} if searching else set()))
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [tuple(k for k, e in enumerate(ends) if e in s) for s in order]
        # Moore's refinement: states are equal if they accept alike and step to equal states
        groups: dict = {}
        block = [groups.setdefault(a, len(groups)) for a in accepts]
        while True:
            groups = {}
            finer = [groups.setdefault((block[s], *(block[t] for t in table[s])), len(groups)) for s in range(len(order))]
            if len(set(finer)) == len(set(block)):
                break
            block = finer
        names: dict[int, int] = {}
        for s in range(len(order)):
            names.setdefault(block[s], len(names))
        member = {names[block[s]]: s for s in reversed(range(len(order)))}
        self.states, self.width = len(names), width
        self.step = [names[block[t]] * width for k in range(len(names)) for t in table[member[k]]]
        self.accepts = {k * width: accepts[member[k]] for k in range(len(names))}
        self.hits = frozenset(s for s, a in self.accepts.items() if a)
        stuck = [k for k in range(len(names)) if not accepts[member[k]] and all(names[block[t]] == k for t in table[member[k]])]
        self.dead = stuck[0] * width if stuck else -1

    def longest(self, seen: bytes, at: int, stop: int, by: int = 1) -> int | None:
        """The furthest end of a match that starts at `at` and goes towards `stop`, over bytes already mapped to classes."""
        s, best, step, hits, dead = 0, None, self.step, self.hits, self.dead
        for k in range(at, stop, by):
            s = step[s + seen[k]]
            if s in hits:
                best = k + by
            elif s == dead:
                break
        return best


    def first(self, seen: bytes, at: int) -> int | None:
        """The end of the first match in bytes from `at` on."""
        s, step, hits = 0, self.step, self.hits
        for k in range(at, len(seen)):
            s = step[s + seen[k]]
            if s in hits:
                return k + 1
        return None


class Scanner:
    def __init__(self, rules: list[tuple[str, str, int, int]] = RULES):
        self.rules = rules
        trees = [_Parser(r[1]).either() for r in rules]
        self.all = Dfa(trees, True)
        self.own = [(Dfa([t], False), Dfa([_reversed(t)], False), Dfa([t], True)) for t in trees]

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches in bytes, by start, then rule; matches under a rule's length limits are dropped
        after the matching, as they keep what they cover from other matches."""
        dfa = self.all
        step, hits, accepts, s = dfa.step, dfa.hits, dfa.accepts, 0
        last = [0] * len(self.rules)  # where the rule's last match ends
        wait = [0] * len(self.rules)  # matches that end up to here are not the rule's next
        out: list[tuple[int, int, int]] = []
        seen: dict[bytes, bytes] = {}

        def classes(of: Dfa) -> bytes:
            if of.classes not in seen:
                seen[of.classes] = raw.translate(of.classes)
            return seen[of.classes]

        for k, c in enumerate(raw.translate(dfa.classes)):
            s = step[s + c]
            if s not in hits:
                continue
            for r in accepts[s]:
                if k < wait[r]:
                    continue
                ahead, back, search = self.own[r]
                start = back.longest(classes(back), k, last[r] - 1, -1)
                if start is None:  # all that ends here starts in the last match: look for what starts behind it, once
                    end = search.first(classes(search), last[r])
                    wait[r] = len(raw) if end is None else end - 1
                    if end != k + 1:
                        continue
                    start = back.longest(classes(back), k, last[r] - 1, -1)
                start += 1
                last[r] = wait[r] = ahead.longest(classes(ahead), start, len(raw)) or k + 1
                _, _, least, least_part = self.rules[r]
                found = raw[start : last[r]]
                if len(found) >= least and (not least_part or self.part(found) >= least_part):
                    out.append((start, last[r], r))
        return sorted(out, key=lambda x: (x[0], x[2]))

    @staticmethod
    def part(found: bytes) -> int:
        """Length of the value behind the first [:=], spaces and an opening quote."""
        at = min(k for k in (found.find(b":"), found.find(b"=")) if k >= 0)
        value = found[at + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'"))

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """spans() in code points."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        found = self.spans(raw)
        if found and len(raw) != len(text):
            places, chars, done = {}, 0, 0
            for at in sorted({p for x in found for p in x[:2]}):
                chars += len(raw[done:at].decode("utf-8", "surrogatepass"))
                places[at], done = chars, at
            found = [(places[a], places[b], r) for a, b, r in found]
        return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list = RULES) -> DataFrame:
    """One row per document: doc_id and found, an array of (kind, start, end) in code points."""
    scanner = Scanner(rules)

    def find(batch: pa.RecordBatch) -> dict[str, list]:
        got = [[{"kind": rules[r][0], "start": a, "end": b} for a, b, r in scanner(t)] for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "found": got}

    kind = with_fields(docs.select(F.col(id_col).alias("doc_id")), "found array<struct<kind:string,start:bigint,end:bigint>>")
    return by_batch(docs.select(id_col, text_col), find, kind)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base kinds' digest and all spans as text, of scan()'s rows."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]", rules: list = RULES) -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans by one), and length_col set to the new number of characters
    where a text changed. Other columns, and texts without spans, stay as they are."""
    scanner = Scanner(rules)
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lengths, changed = batch.column(at).to_pylist(), None if length_at is None else batch.column(length_at).to_pylist(), False
        for k, text in enumerate(texts):
            found = scanner(text)
            if found:
                parts, done, changed = [], 0, True
                for a, b, _ in found:
                    if a >= done:
                        parts += [text[done:a], mark]
                    done = max(done, b)
                texts[k] = "".join([*parts, text[done:]])
                if lengths is not None:
                    lengths[k] = len(texts[k])
        if not changed:
            return batch
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if lengths is not None:
            columns[length_at] = pa.array(lengths, batch.schema.field(length_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return by_batch(docs, clean, docs.schema)
