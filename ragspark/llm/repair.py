"""Conversation structure repair by a generalised LR parse of the roles.

The role grammar becomes an LR automaton. Its stacks form a graph: a node is (state, node below) and is shared by all
stacks that go through it. A row is kept or reroled, which shifts its symbol, or deleted, which leaves the stack; a row may
be inserted before any other and at the end. Stacks with one and the same top node are merged: the least (cost, audit) stays. What all
living stacks have in common of their audits is settled and put aside, so a conversation of any length is parsed
with a few short strings. A stack that is dearer than the best by more than any repair of the best could cost is dropped.

Rows are judged with DataFrame functions: damage, faults, and copies, which a window numbers by conversation and digest. Two streams
over rows sorted by conversation follow, the first over their symbols, the second over their texts behind the audit. Neither
holds a conversation, so one with a third of all rows takes long in one task but no memory: its digest is sequential by nature.
"""

import hashlib
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Left and right sides over role initials; the first left side is the start. It derives (s?(ua)+)?.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: From any stack the repair of any other costs at most one deletion and two insertions more.
SLACK = DELETE + 2 * INSERT
SETTLE_ROWS, SHORT = 64, 64
SPACES = " \t\n\x0b\x0c\r"

EDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PARSED = f"conv_id long, {EDITS}"
RESULT = f"{PARSED}, repaired_sha256 string"


class Automaton:
    """LR(0) states of a grammar: ``move[state][symbol]``, the productions complete in a state, those of the start apart."""

    def __init__(self, grammar=GRAMMAR):
        self.start = grammar[0][0]
        lefts = {left for left, _ in grammar}

        def closed(items):
            items = set(items)
            while True:
                new = {(i, 0) for k, dot in items if dot < len(grammar[k][1]) for i, (left, _) in enumerate(grammar) if left == grammar[k][1][dot]} - items
                if not new:
                    return frozenset(items)
                items |= new

        first = closed((i, 0) for i, (left, _) in enumerate(grammar) if left == self.start)
        states, self.move = [first], []
        for items in states:
            row = {}
            for symbol in sorted({grammar[k][1][dot] for k, dot in items if dot < len(grammar[k][1])}):
                to = closed((k, dot + 1) for k, dot in items if grammar[k][1][dot : dot + 1] == symbol)
                if to not in states:
                    states.append(to)
                row[symbol] = states.index(to)
            self.move.append(row)
        done = [[grammar[k] for k, dot in items if dot == len(grammar[k][1])] for items in states]
        self.reduce = [[(left, len(right)) for left, right in own if left != self.start] for own in done]
        self.accept = [[len(right) for left, right in own if left == self.start] for own in done]
        self.shifts = [any(s not in lefts for s in row) for row in self.move]


class Repair:
    """The cheapest edits of one conversation, fed row by row."""

    def __init__(self, automaton, slack=SLACK):
        self.lr, self.slack = automaton, slack
        self.nodes = {}
        self.bottom = self.node(0, None)
        self.settled, self.base, self.fed = [], 0, 0
        self.tops = {}
        self._close({self.bottom: (0, "")})

    def node(self, state, below):
        return self.nodes.setdefault((state, id(below)), (state, below))

    def _put(self, tops, node, cost, audit):
        """Keys are node objects' ids with the node beside, so that equal tops meet."""
        old = tops.get(id(node))
        if old is None or (cost, audit) < old[1:]:
            tops[id(node)] = (node, cost, audit)
            return True
        return False

    def _close(self, found):
        """Adds what reductions and insertions reach, then drops hopeless and merely passing stacks."""
        tops, work = {}, []
        for node, (cost, audit) in found.items():
            if self._put(tops, node, cost, audit):
                work.append(node)
        while work:
            node = work.pop()
            _, cost, audit = tops[id(node)]
            state = node[0]
            for left, n in self.lr.reduce[state]:
                base = node
                for _ in range(n):
                    base = base[1]
                to = self.node(self.lr.move[base[0]][left], base)
                if self._put(tops, to, cost, audit):
                    work.append(to)
            for symbol in ROLES:
                if symbol in self.lr.move[state]:
                    to = self.node(self.lr.move[state][symbol], node)
                    if self._put(tops, to, cost + INSERT, audit + "I"):
                        work.append(to)
        least = min(c for _, c, _ in tops.values())
        self.tops = {
            k: t for k, t in tops.items()
            if (self.lr.shifts[t[0][0]] or self.lr.accept[t[0][0]]) and (self.slack is None or t[1] <= least + self.slack)
        }

    def feed(self, symbol, must_go, truncated):
        extra, new = TRUNCATED if truncated else 0, {}

        def put(node, cost, audit):
            old = new.get(node)
            if old is None or (cost, audit) < old:
                new[node] = (cost, audit)

        for node, cost, audit in self.tops.values():
            put(node, cost + DELETE, audit + "D")
            if must_go:
                continue
            move = self.lr.move[node[0]]
            if symbol in move and symbol in "sua":
                put(self.node(move[symbol], node), cost + KEEP + extra, audit + "K")
            for role in ROLES:
                if role in move:
                    put(self.node(move[role], node), cost + REROLE + extra, audit + "R")
        self._close(new)
        self.fed += 1
        if self.fed % SETTLE_ROWS == 0:
            common = len(os.path.commonprefix([a for *_, a in self.tops.values()]))
            least = min(c for _, c, _ in self.tops.values())
            self.settled.append(next(iter(self.tops.values()))[2][:common])
            self.base += least
            self.tops = {k: (n, c - least, a[common:]) for k, (n, c, a) in self.tops.items()}

    def result(self):
        """(cost, audit) of the best stack that the grammar accepts."""
        best = None
        for node, cost, audit in self.tops.values():
            for n in self.lr.accept[node[0]]:
                base = node
                for _ in range(n):
                    base = base[1]
                if base is self.bottom and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        return self.base + best[0], "".join(self.settled) + best[1]


@lru_cache(1)
def automaton():
    return Automaton()


@lru_cache(20_000)
def repaired(codes):
    """(cost, audit) for a short conversation: per row its symbol and '-' (fine), 't' (truncated) or 'x' (must go)."""
    repair = Repair(automaton())
    for k in range(0, len(codes), 2):
        repair.feed(codes[k], codes[k + 1] == "x", codes[k + 1] == "t")
    return repair.result()


class Conversation:
    """Counts and edits of one conversation whose rows come in order."""

    def __init__(self):
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.codes, self.long = 0, None, [], None

    def feed(self, turn, initial, fault):
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = (initial if initial in ROLES or initial == "s" else "?") + {"": "-", "truncated": "t"}.get(fault, "x")
        if self.long is None and len(self.codes) == SHORT:
            self.long = Repair(automaton())
            for c in self.codes:
                self.long.feed(c[0], c[1] == "x", c[1] == "t")
        if self.long is None:
            self.codes.append(code)
        else:
            self.long.feed(code[0], code[1] == "x", code[1] == "t")

    def row(self):
        cost, audit = repaired("".join(self.codes)) if self.long is None else self.long.result()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, cost, audit


class Text:
    """The digest of a repaired conversation, whose rows come in order behind its edits."""

    def __init__(self, edits):
        self.edits, self.audit, self.at = edits, edits[-1], 0
        self.hash, self.empty, self.before = hashlib.sha256(), True, None

    def _line(self, role, text):
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty, self.before = False, role[:1]

    def _due(self):
        return "assistant" if self.before == "u" else "user"

    def _insert(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._due(), "")
            self.at += 1

    def feed(self, role, text):
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._due(), text)

    def row(self):
        self._insert()
        return *self.edits, self.hash.hexdigest()


def damaged(rows, conv_id="conv_id", turn="turn", role="role", text="text"):
    """conv_id, turn, role, text, copy and ``gone`` of every row after damage; a dropped row stays, marked as gone."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    out = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), k.alias("_k"), blank(role).alias("role"), blank(text).alias("text"),
    )
    new_text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), copies.alias("copy"), (F.col("_k") == 0).alias("gone"))


def _order():
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def repair(rows):
    """Per conversation of ``rows`` (as ``damaged`` gives them) its faults, the cheapest edits and the repaired text's digest.

    Rows count in the order of turn (nulls first), role and digest of the text; a null conversation is one of its own. A
    row's first fault counts: blank, duplicate, truncated. Roles other than those of the grammar can be reroled or
    deleted only. A conversation without rows has zeros, no edits and the digest of the empty text.
    """
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    told = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    copies = W.partitionBy("gone", "conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    narrow = told.select("conv_id", "turn", "role", "digest", "copy", "gone", tail.alias("tail")).withColumn("nth", F.row_number().over(copies))
    fault = F.when(F.col("tail") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("tail").isin(".", "!", "?"), "truncated").otherwise("")
    judged = narrow.withColumn("fault", fault).repartition("conv_id").sortWithinPartitions(*_order(), "nth").select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "gone")

    def parse(batches):
        key, now = None, None
        for b in batches:
            out = []
            for conv, turn, initial, fault_, gone in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.row()))
                    key, now = conv, Conversation()
                if not gone:
                    now.feed(turn, initial, fault_)
            yield from _batches(out, PARSED)
        if now is not None:
            yield from _batches([(key, *now.row())], PARSED)

    edits = judged.mapInArrow(parse, PARSED)
    names = [f.name for f in edits.schema.fields[1:]]
    own = told.where("not gone").select("conv_id", "turn", "role", "digest", "copy", "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in edits.schema.fields[1:]))
    head = edits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).alias("copy"), F.lit("").alias("text"), *names)
    # the row with the edits comes first: it alone has copy 0
    both = head.unionByName(own).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), (F.col("copy") > 0), *_order()[1:]).select("conv_id", "copy", "role", "text", *names)

    def digests(batches):
        key, now = None, None
        for b in batches:
            out = []
            for conv, copy, role, text, *own_ in zip(*(c.to_pylist() for c in b.columns)):
                if copy == 0:
                    if now is not None:
                        out.append((key, *now.row()))
                    key, now = conv, Text(own_)
                else:
                    now.feed(role, text)
            yield from _batches(out, RESULT)
        if now is not None:
            yield from _batches([(key, *now.row())], RESULT)

    return both.mapInArrow(digests, RESULT)


def _batches(rows, columns):
    """One batch of ``rows``, or none; ``columns`` names long and string columns as DDL."""
    if rows:
        fields = [c.split() for c in columns.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


#: The same by a recursion over the rows, its states the four places in (s?(ua)+)?.
SQL = r"""
with recursive bits as (
  select list_reduce([n] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v, n from (select unnest(range(256)::bigint[]) as n)),
crc_table as (select list(v order by n) as t from bits),
coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(4294967295, list_reduce([4294967295] || list_transform(range(length(key)), lambda i: ascii(key[i + 1])::bigint),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) % 20 as k
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations), crc_table),
hurt as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from coded where k <> 0),
told as (
  select *, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) as tail, md5(text) as digest,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from hurt),
judged as (
  select conv_id, turn, role, text, left(role, 1) as initial,
    case when tail = '' then 'blank' when nth > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
    row_number() over (partition by conv_id order by turn nulls first, role, digest, copy, nth) as i,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, digest, copy, nth) as prior from told),
jumps(a, b, ins) as (values (0,0,''), (0,2,'I'), (0,3,'II'), (1,1,''), (1,2,'I'), (1,3,'II'), (2,2,''), (2,3,'I'), (3,3,''), (3,2,'I'), (2,2,'II'), (3,3,'II')),
moves(a, b, edit, symbol) as (values
  (0,1,'K','s'), (0,2,'K','u'), (1,2,'K','u'), (3,2,'K','u'), (2,3,'K','a'), (0,2,'R',''), (1,2,'R',''), (3,2,'R',''), (2,3,'R',''),
  (0,0,'D',''), (1,1,'D',''), (2,2,'D',''), (3,3,'D','')),
paths as (
  select conv_id, 0::bigint as i, 0 as state, {'cost': 0::bigint, 'audit': ''} as best from (select distinct conv_id from conversations)
  union all
  select p.conv_id, p.i + 1, m.b, min({'cost': p.best.cost + 3 * length(j.ins)
      + case m.edit when 'D' then 4 when 'R' then 3 else 0 end + case when m.edit <> 'D' and r.fault = 'truncated' then 3 else 0 end, 'audit': p.best.audit || j.ins || m.edit})
  from paths p join judged r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1 join jumps j on j.a = p.state
    join moves m on m.a = j.b and (m.edit <> 'K' or m.symbol = r.initial) and (m.edit = 'D' or r.fault not in ('blank', 'duplicate'))
  group by p.conv_id, p.i, m.b),
sizes as (select c.conv_id, count(r.i) as n from (select distinct conv_id from conversations) c left join judged r on r.conv_id is not distinct from c.conv_id group by c.conv_id),
ended as (
  select p.conv_id, min({'cost': p.best.cost + 3 * length(j.ins), 'audit': p.best.audit || j.ins}) as best
  from paths p join sizes s on s.conv_id is not distinct from p.conv_id and s.n = p.i join jumps j on j.a = p.state and j.b in (0, 3)
  where j.b <> 0 or p.state = 0 group by p.conv_id),
letters as (
  select conv_id, best.audit as audit, unnest(range(1, length(best.audit) + 1)) as k from ended),
edits as (
  select conv_id, k, audit[k] as edit, sum((audit[k] <> 'I')::int) over (partition by conv_id order by k) as i,
    sum((audit[k] <> 'D')::int) over (partition by conv_id order by k) as line from letters),
with_text as (
  select e.*, r.role, r.text, r.initial, first_value(case when e.edit = 'K' and r.initial = 's' then 1 else 0 end) over (partition by e.conv_id order by e.edit = 'D', e.k) as system
  from edits e left join judged r on r.conv_id is not distinct from e.conv_id and r.i = e.i and e.edit <> 'I'),
lines as (
  select conv_id, k, case when edit = 'K' then role || ':' || text else (case when (line - system) % 2 = 1 then 'user:' else 'assistant:' end) || case when edit = 'R' then text else '' end end as line
  from with_text where edit <> 'D'),
texts as (select conv_id, string_agg(line, chr(10) order by k) as text from lines group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (prior is not null and prior || initial not in ('su', 'ua', 'au')) as illegal from judged group by conv_id)
select e.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
  coalesce(c.illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit, sha256(coalesce(t.text, '')) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id left join texts t on t.conv_id is not distinct from e.conv_id
"""
