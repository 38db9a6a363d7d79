"""Secret scan by a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. A Boolean trigram query (an AND of ORs of ANDs is enough for these rules) is derived from
the expression's literals; postings of the query trigrams are built over all documents and intersected, and only candidate
documents are verified with the expression. Rules without a mandatory trigram scan every document.

Only texts that hold the rarest trigram of some alternative travel to meet the intersected postings; the others cannot be
candidates and are scanned where they lie for the rules without trigrams. Postings name a text by its id and its hash, so null
and shared ids are no common key.

Offsets come from splitting a text at the rule's matches: the pieces between matches and the matches themselves alternate, so
running sums of their lengths are the positions (code points, end exclusive). They are summed by blocks, and redaction puts the
pieces between spans together from blocks of the text, so that a text of very many spans costs little more than its length.

Defined results: null and empty texts have no spans; repeated rows are scanned each; rows that agree in doc_id and text share
their candidate flags; an empty table gives an empty result; extra columns are kept, or ignored by the digest, whatever their
names. Whole texts are scanned, however long.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rx
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import bind
from .common import cut, drop

# The base rules. ``least`` is the length that group ``group`` of a match must reach.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", ASSIGN, 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    # further rules, all with public formats and long fixed prefixes
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


_ANY: list[frozenset[str]] = [frozenset()]
_MOST = 32
_BLOCK = 1024


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Conjunction of two queries in disjunctive form, without alternatives that another one makes redundant."""
    every = {x | y for x in a for y in b}
    return sorted((x for x in every if not any(y < x for y in every)), key=sorted)


def _grams(strings: set[str]) -> list[frozenset[str]]:
    """A text that holds one of the strings holds all trigrams of one alternative; a short string rules nothing out."""
    if any(len(s) < 3 for s in strings):
        return _ANY
    return _both([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings], _ANY)


def _walk(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """The exact strings of a parsed expression if they are few, else None, and its trigram query."""
    now, query, exact = {""}, _ANY, True

    def flush() -> None:
        nonlocal now, query, exact
        query, now, exact = _both(query, _grams(now)), {""}, False

    for op, arg in items:
        few: set[str] | None = None
        inner = _ANY
        if op is rx.LITERAL:
            few = {chr(arg).lower()}
        elif op is rx.IN and all(o is rx.LITERAL for o, _ in arg):
            few = {chr(c).lower() for _, c in arg}
        elif op is rx.SUBPATTERN:
            few, inner = _walk(arg[-1])
        elif op is rx.BRANCH:
            parts = [_walk(branch) for branch in arg[1]]
            if all(p[0] is not None for p in parts):
                few = set().union(*(p[0] for p in parts))
            else:
                inner = [x for p, q in parts for x in (q if p is None else _both(q, _grams(p)))]
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            few = _walk(arg[2])[0]
            few = few and few | {""}
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and arg[0] > 0:
            once, inner = _walk(arg[2])
            if once is not None and len(now) * len(once) <= _MOST:
                now = {a + b for a in now for b in once}
        if few is None or len(now) * len(few) > _MOST:
            flush()
            query = _both(query, inner)
            now = few if few is not None and len(few) <= _MOST else now
        else:
            now = {a + b for a in now for b in few}
    if exact:
        return now, _ANY
    return None, _both(query, _grams(now))


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Derived from the rule's expression: alternatives of trigram sets. A text that matches the rule holds, in lower case,
    every trigram of some alternative. Empty if the expression has no mandatory trigram: such a rule scans every text."""
    strings, query = _walk(_parser.parse(rule.pattern))
    if strings is not None:
        query = _grams(strings)
    return [] if frozenset() in query else query


def postings(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc, mark, gram): the trigrams, as places in ``vocabulary``, that each text (``low``, in lower case) holds."""
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary)]))
    return rows.select("doc", "mark", F.explode(held).alias("gram")).distinct()


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """(doc, mark, kinds) of the texts whose postings meet a rule's trigram query, and the rarest trigram of every alternative.

    Postings are built for the trigrams of the queries alone; the lists of an alternative's trigrams are intersected by counting,
    after a map-side pre-aggregation. A list's length goes to the driver, one number per trigram of the rules.
    """
    alternatives = [(r.kind, grams) for r in rules for grams in trigram_query(r)]
    vocabulary = sorted({g for _, grams in alternatives for g in grams})
    code = {g: i for i, g in enumerate(vocabulary)}
    index = cut(postings(rows, vocabulary), "secret-postings")
    length = {vocabulary[r["gram"]]: r["n"] for r in index.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    wanted = rows.sparkSession.createDataFrame(
        [(code[g], k, kind, len(grams)) for k, (kind, grams) in enumerate(alternatives) for g in sorted(grams)],
        "gram int, alternative int, kind string, needed int",
    )
    met = (
        index.join(F.broadcast(wanted), "gram").groupBy("doc", "mark", "alternative").agg(F.count("*").alias("n"), F.first("needed").alias("needed"), F.first("kind").alias("kind"))
        .filter("n = needed")
    )
    found = cut(met.groupBy("doc", "mark").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")
    drop(index)
    return found, sorted({min(grams, key=lambda g: (length.get(g, 0), g)) for _, grams in alternatives})


def running(items: Column, zero: Column, step) -> Column:
    """What ``step(value, item)`` gives over all items before each one, from ``zero`` on.

    An array grows by copying, so this goes by blocks of about the root of their number: over n items it costs n times that root.
    """
    width = F.ceil(F.sqrt(F.size(items))).cast("int")

    def grown(parts: Column, first: Column, fold) -> Column:
        """The value before each part."""
        start = F.struct(first.alias("value"), F.array_remove(F.array(first), first).alias("before"))
        return F.aggregate(parts, start, lambda acc, x: F.struct(fold(acc["value"], x).alias("value"), F.array_append(acc["before"], acc["value"]).alias("before")))["before"]

    def by_blocks(blocks: Column) -> Column:
        firsts = grown(blocks, zero, lambda value, block: F.aggregate(block, value, step))
        return F.flatten(F.zip_with(blocks, firsts, lambda block, first: grown(block, first, step)))

    blocks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.greatest(width, F.lit(1))), lambda at: F.slice(items, at + 1, width))
    none = F.array_remove(F.array(zero), zero)
    return F.when(F.size(items) > 0, bind(blocks, by_blocks)).otherwise(none)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's leftmost non-overlapping matches that pass its length test."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), 1)
    tested = F.regexp_extract_all(text, pattern, rule.group) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    lengths = F.arrays_zip(F.transform(whole, lambda m: F.length(m)).alias("whole"), F.transform(tested, lambda m: F.length(m)).alias("tested"), gaps.alias("gap"))

    def placed(rows: Column) -> Column:
        starts = running(rows, F.lit(0), lambda at, x: at + x["gap"] + x["whole"])
        every = F.zip_with(rows, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind"), x["tested"].alias("tested")))
        return F.transform(F.filter(every, lambda s: s["tested"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    # of every match and the piece before it; the piece behind the last match has no partner
    return bind(lengths, lambda rows: placed(F.filter(rows, lambda x: x["whole"].isNotNull())))


def _quick(rule: Rule) -> str:
    """A cheaper expression that every match which passes the length test contains."""
    if rule.kind == "hex":
        return "[0-9a-f]{%d}" % rule.least
    return rule.pattern


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found") -> DataFrame:
    """Every row of ``docs`` (all columns but one named ``into``) with ``into``: array of (start, end, kind) by start, then rule
    order."""
    names = [c for c in docs.columns if c != into]
    text, ident = (f"_d{names.index(c)}" for c in ("text", "doc_id"))
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)])
    hidden = hidden.withColumn("_doc", F.coalesce(F.col(ident).cast("long"), F.lit(-1).cast("long"))).withColumn("_mark", F.xxhash64(text))
    low = hidden.filter(F.col(text) != "").select(F.col("_doc").alias("doc"), F.col("_mark").alias("mark"), F.lower(text).alias("low"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    order = F.array(*[F.lit(r.kind) for r in rules])

    def verified(rows: DataFrame, chosen: list[Rule], kinds: Column | None) -> DataFrame:
        each = []
        for rule in chosen:
            may = F.col(text).rlike(_quick(rule))
            if trigram_query(rule):
                may = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) & may
            each.append(F.when(may, spans_of(F.col(text), rule)).otherwise(none))
        every = F.concat(*each) if each else none
        ranked = F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return rows.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)], F.array_sort(ranked).alias(into))

    free = [r for r in rules if not trigram_query(r)]
    if len(free) == len(rules):
        return verified(hidden, free, None)
    flagged, rarest = candidates(low, rules)
    travels = F.lit(False)
    for gram in rarest:
        travels = travels | F.contains("_low", F.lit(gram))
    marked = hidden.withColumn("_low", F.lower(text)).withColumn("_goes", F.coalesce(travels, F.lit(False))).drop("_low")
    flagged = flagged.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("kinds").alias("_kinds"))
    there = marked.filter("_goes").join(flagged, ["_doc", "_mark"], "left")
    return verified(there, list(rules), F.col("_kinds")).unionByName(verified(marked.filter("not _goes"), free, None))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), rules).select("doc_id", "found")
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select(F.col("doc_id").cast("long"), *[count(k) for k in base], F.sha2(_joined(only), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _stretch(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text cut into blocks of ``_BLOCK``: costs what it holds and two blocks, wherever it lies."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
    block = lambda k: F.get(blocks, k)
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over = F.concat(F.substring(block(first), start - first * _BLOCK + 1, F.lit(_BLOCK)), inner, F.substring(block(last), F.lit(1), end - last * _BLOCK))
    return F.when(end <= start, "").when(first == last, F.substring(block(first), start - first * _BLOCK + 1, end - start)).otherwise(over)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans once) and ``n_chars``, if there, counted anew."""
    into = next(c for c in (f"found{i}" for i in range(len(docs.columns) + 1)) if c not in {d.lower() for d in docs.columns})
    found = find_secrets(docs, rules, into)
    spans = F.col(into)

    def cleaned(blocks: Column) -> Column:
        before = running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        kept = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(_stretch(blocks, at, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), _stretch(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length("text")))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)
    clean = F.when(F.size(into) > 0, bind(blocks, cleaned)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
