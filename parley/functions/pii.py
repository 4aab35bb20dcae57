"""PII detection and redaction in staged projections.

Everything here is narrow, per-row work of Spark's regex and higher-order
array functions, run in the JVM next to the scan. No Python runs per row.

Entity semantics:
* every pattern is applied case-insensitively with left-to-right,
  non-overlapping matching;
* offsets are code-point offsets, ``end`` exclusive;
* overlaps are resolved greedily by priority (confidence descending, then
  detection order, i.e. pattern order, then leftmost within a pattern); a
  candidate is kept iff it overlaps no entity already kept (touching is fine);
* the kept entities are ordered by ``start``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference for equal results): entity types and
# their patterns, in priority order, all applied case-insensitively; the
# confidence given to every regex match; the confidence of external name
# entities and the labels taken from an entity annotation table.
PII_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"(?:\+?1[-.]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.]?\d{4})\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ORDER_ID", r"\b(?:order|tracking)[\s#:]*(?=[A-Z0-9]*\d)[A-Z0-9]{6,15}\b"),
    ("ZIP_CODE", r"\b\d{5}-\d{4}\b"),
]
REGEX_CONFIDENCE = 0.95
NAME_CONFIDENCE = 0.75
NAME_LABELS = ["PERSON", "ORG"]
GENERIC_PLACEHOLDER = "[REDACTED]"

PATTERN_BY_TYPE = dict(PII_PATTERNS)

# ``start`` leads so that kept (non-overlapping) entities sort by start with
# the natural struct ordering, no comparator lambda.
ENTITY = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
ENTITIES = T.ArrayType(ENTITY)


#: Up to so many matches of one text are folded in one go; more are folded by blocks.
BLOCK = 128

# Literal every match of a type contains: rows without it skip that pattern.
REQUIRED_LITERAL = {"EMAIL": "@", "SSN": "-", "IP_ADDRESS": ".", "ZIP_CODE": "-"}

# What every match of a type starts with, looked at before the boundary and the optional parts of its pattern are tried at a place.
LEADING = {"PHONE": r"(?=[+(\d])", "SSN": r"(?=\d)", "CREDIT_CARD": r"(?=\d)", "IP_ADDRESS": r"(?=\d)", "ZIP_CODE": r"(?=\d)"}


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _by_length(candidates: Column) -> Column:
    """Stable re-order: longest span first, detection order among equals."""
    indexed = F.transform(candidates, lambda e, i: F.struct((e["start"] - e["end"]).alias("neg_len"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(indexed), lambda x: x["e"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it (lambdas have no common-subexpression elimination)."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column) -> Column:
    """A non-empty array as an array of blocks of ``BLOCK`` entries, or of the
    root of its size where that is more."""
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1, size), lambda at: F.slice(values, at + 1, size))


def _running_fold(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def running(values: Column, size: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``zero`` and the folds of the first 1, 2, ... ``size`` (all) integers by ``step``.

    A fold that appends copies its array for every entry; beyond ``BLOCK``
    entries the blocks are folded whole first, and then within themselves."""

    def within(blocks: Column) -> Column:
        heads = F.aggregate(
            blocks, F.array(zero), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), step)))
        )
        folds = F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), lambda block, head: F.slice(_running_fold(block, head, step), 2, F.size(block)))
        return F.concat(F.array(zero), F.flatten(folds))

    return F.when(size <= BLOCK, _running_fold(values, zero, step)).otherwise(_let(values, lambda v: _let(_blocks(v), within)))


def _greedy(ordered: Column) -> Column:
    """The candidates, best first, that overlap none kept before them, by start."""
    kept = F.aggregate(
        ordered,
        F.array().cast(ENTITIES),
        lambda acc, e: F.when(F.exists(acc, lambda k: _overlaps(e, k)), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return F.array_sort(kept)


def _swept(ordered: Column) -> Column:
    """``_greedy`` of many candidates: those sorted by start fall into clusters
    where one starts behind the ends of all before it; no overlap crosses
    clusters, so each is resolved by itself. Time is that of the sort, and
    quadratic only in the size of one chain of overlapping candidates."""

    def in_clusters(by_start: Column, firsts: Column) -> Column:
        last = F.size(by_start)

        def resolved(first: Column, i: Column) -> Column:
            n = F.coalesce(F.get(firsts, i + 1), last) - first
            cluster = F.sort_array(F.transform(F.slice(by_start, first + 1, n), lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"))))
            return F.when(n == 1, F.array(by_start[first]["e"])).otherwise(_greedy(F.transform(cluster, lambda x: x["e"])))

        return F.array_sort(F.flatten(F.transform(firsts, resolved)))  # empty spans may share a place

    def sweep(by_start: Column) -> Column:
        ends = running(F.transform(by_start, lambda x: x["end"]), F.size(by_start), F.lit(0), lambda top, end: F.greatest(top, end))
        starts = F.transform(by_start, lambda x: x["start"])
        # a null offset overlaps nothing
        opens = F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda start, top: F.coalesce(start >= top, F.lit(True)))
        firsts = F.filter(F.transform(opens, lambda o, i: F.when(o, i)), lambda i: i.isNotNull())
        return _let(firsts, lambda x: in_clusters(by_start, x))

    indexed = F.transform(ordered, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), i.alias("i"), e.alias("e")))
    return _let(F.sort_array(indexed), sweep)


def resolve_overlaps(candidates: Column, size: Column, by_confidence: bool = False, priority: str = "reference") -> Column:
    """Greedy overlap resolution, then order by start.

    ``candidates`` (``size`` of them) must already be in detection order. With
    ``by_confidence=True`` they are first stably re-ordered by confidence
    descending (needed only when external entities of higher confidence follow
    the regex ones; with the fixed confidences detection order already is
    priority order).
    """
    ordered = _by_length(candidates) if priority == "longest" else candidates
    if by_confidence:
        indexed = F.transform(ordered, lambda e, i: F.struct((-e["confidence"]).alias("neg_confidence"), i.alias("i"), e.alias("e")))
        ordered = F.transform(F.array_sort(indexed), lambda x: x["e"])
    return F.when(size <= BLOCK, _greedy(ordered)).otherwise(_swept(ordered))


def resolve_matches(candidates: Column) -> Column:
    """``resolve_overlaps`` of pattern matches in detection order. Those of one
    pattern neither overlap nor need ordering, and two are compared as they
    are: most texts get by without a fold, which runs interpreted."""
    size = F.size(candidates)
    first, second = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    one_pattern = first["type"] == F.get(candidates, size - 1)["type"]
    pair = (
        F.when(_overlaps(second, first), F.slice(candidates, 1, 1))
        .when(second["start"] < first["start"], F.array(second, first))
        .otherwise(candidates)
    )
    return F.when((size <= 1) | one_pattern, candidates).when(size == 2, pair).when(size <= BLOCK, _greedy(candidates)).otherwise(_swept(candidates))


def redact_with(text: Column, entities: Column, style: str = "type") -> Column:
    """Replace each entity span by ``[TYPE]`` (style ``type``) or ``[REDACTED]``
    (any other style). No entity → text unchanged.

    One or two entities are cut out without a fold. A substring is found by
    walking its text from the start, and a fold copies what it has put
    together; beyond ``BLOCK`` entities the text is cut by blocks of them first."""

    def placeholder(e: Column) -> Column:
        if style == "type":
            return F.concat(F.lit("["), e["type"], F.lit("]"))
        return F.lit(GENERIC_PLACEHOLDER)

    def replaced(part: Column, of: Column, base: Column, end: Callable[[Column], Column]) -> Column:
        """``end`` of (out, pos): ``part``, which starts at ``base``, up to the end of its last entity."""
        return F.aggregate(
            of,
            F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")),
            lambda acc, e: F.struct(
                F.concat(acc["out"], part.substr(acc["pos"] + 1, e["start"] - base - acc["pos"]), placeholder(e)).alias("out"),
                (e["end"] - base).alias("pos"),
            ),
            end,
        )

    def rest(end: Column) -> Column:
        return text.substr(end + 1, F.lit(2147483647))

    def by_blocks(blocks: Column) -> Column:
        def block_out(block: Column, i: Column) -> Column:
            base = F.coalesce(F.element_at(F.get(blocks, i - 1), -1)["end"], F.lit(0))
            part = text.substr(base + 1, F.element_at(block, -1)["end"] - base)
            return _let(F.struct(part.alias("part"), base.alias("base")), lambda x: replaced(x["part"], block, x["base"], lambda acc: acc["out"]))

        last = F.element_at(F.element_at(blocks, -1), -1)["end"]
        return F.concat(F.array_join(F.transform(blocks, block_out), ""), rest(last))

    few = replaced(text, entities, F.lit(0), lambda acc: F.concat(acc["out"], rest(acc["pos"])))
    first, second = F.get(entities, F.lit(0)), F.get(entities, F.lit(1))
    head = [text.substr(F.lit(1), first["start"]), placeholder(first)]
    one = F.concat(*head, rest(first["end"]))
    two = F.concat(*head, text.substr(first["end"] + 1, second["start"] - first["end"]), placeholder(second), rest(second["end"]))
    size = F.size(entities)
    return F.when(size == 0, text).when(size == 1, one).when(size == 2, two).when(size <= BLOCK, few).otherwise(_let(_blocks(entities), by_blocks))


def entity_types(entities: Column) -> Column:
    """Distinct entity types, sorted (the reference returns an unordered set)."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))


def pii_metadata(entities: Column) -> Column:
    return F.struct(
        (F.size(entities) > 0).alias("pii_detected"),
        F.size(entities).alias("entity_count"),
        entity_types(entities).alias("entity_types"),
        F.transform(
            entities,
            lambda e: F.struct(
                e["type"].alias("type"),
                e["confidence"].alias("confidence"),
                F.struct(e["start"].alias("start"), e["end"].alias("end")).alias("position"),
            ),
        ).alias("entities"),
    )


def may_contain_pii(text: Column, unicode: bool = True) -> Column:
    """Cheap necessary condition for any regex entity: every pattern needs a
    digit or an ``@``. Rows failing it skip the array machinery."""
    return text.rlike(r"[@\p{Nd}]" if unicode else "[0-9@]")


_EMPTY_STR_ARRAY = "array<string>"
_TEXT_SCRATCH = "_pii_text"
_EXT_SCRATCH = "_pii_ext"
_GATE, _CANDIDATES = "_pii_gate", "_pii_candidates"


def _match(etype: str, pattern: str) -> str:
    return LEADING.get(etype, "") + pattern


def _scan(text: Column, pattern: str, unicode: bool) -> Column:
    """All matches of the pattern, case-insensitive, with Unicode classes
    (``\\d``, ``\\s``, ``\\b`` as in Python's ``re`` on str) or Java's ASCII
    classes. On ASCII texts both match the same, so one form serves every text."""
    return F.regexp_extract_all(text, F.lit(("(?iU)" if unicode else "(?i)") + pattern), 0)


def _entity(etype: Column, value: Column, end: Column) -> Column:
    return F.struct(
        (end - F.length(value)).cast("int").alias("start"),
        end.cast("int").alias("end"),
        etype.alias("type"),
        value.alias("value"),
        F.lit(REGEX_CONFIDENCE).alias("confidence"),
    )


@lru_cache(maxsize=64)
def _entity_stages(text_col: str, external_col: str | None, priority: str, unicode: bool, types: tuple | None, candidates: bool) -> tuple:
    """Column expressions of the stages, built once per column names
    (they refer to columns by name only, so the same JVM expressions serve
    every DataFrame; building them costs thousands of Py4J calls)."""
    chosen = [(t, p) for t, p in PII_PATTERNS if types is None or t in types]
    text = F.col(text_col)
    gate = may_contain_pii(text, unicode)
    if external_col is not None:
        gate = gate | (F.size(F.col(external_col)) > 0)
    stage0 = {_GATE: gate}
    empty = F.array().cast(_EMPTY_STR_ARRAY)
    stage1 = {}
    for t, p in chosen:
        cond = F.col(_GATE)
        if t in REQUIRED_LITERAL:
            cond = cond & (F.instr(text, REQUIRED_LITERAL[t]) > 0)
        stage1[f"_m_{t}"] = F.when(cond, _scan(text, _match(t, p), unicode)).otherwise(empty)
    found = {t: F.size(f"_m_{t}") for t, _ in chosen}
    # the length of each match with the gap before it: it starts where the last one ended
    stage2 = {f"_l_{t}": F.when(found[t] > 0, F.transform(_scan(text, rf"(?s)\G.*?(?:{_match(t, p)})", unicode), F.length)) for t, p in chosen}
    none = F.array().cast(ENTITIES)

    def entities(t: str) -> Column:
        values, lengths = F.col(f"_m_{t}"), F.col(f"_l_{t}")
        single = F.array(_entity(F.lit(t), F.get(values, F.lit(0)), F.get(lengths, F.lit(0))))
        ends = running(lengths, found[t], F.lit(0), lambda at, n: at + n)
        several = _let(ends, lambda end: F.transform(values, lambda v, i: _entity(F.lit(t), v, end[i + 1])))
        return F.when(found[t] == 0, none).when(found[t] == 1, single).otherwise(several)

    stage3 = {_CANDIDATES: F.when(sum(found.values(), F.lit(0)) == 0, none).otherwise(F.concat(*(entities(t) for t, _ in chosen)))}
    every = F.col(_CANDIDATES)
    if candidates:
        resolved = every
    elif external_col is not None:
        external = F.coalesce(F.col(external_col), none)
        resolved = resolve_overlaps(F.concat(every, external), F.size(every) + F.size(external), by_confidence=True, priority=priority)
    elif priority == "longest":
        resolved = resolve_overlaps(every, F.size(every), priority=priority)
    else:
        resolved = resolve_matches(every)
    return stage0, stage1, stage2, stage3, resolved


def with_entities(df: DataFrame, text_col: str, out_col: str = "entities", external_col: str | None = None,
                  priority: str = "reference", unicode: bool = True, types: list[str] | None = None, candidates: bool = False) -> DataFrame:
    """Add the resolved entity array of ``text_col`` as ``out_col``; with
    ``candidates`` all matches in detection order, overlaps included. ``types``
    limits the patterns.

    ``priority``: ``reference`` (pattern order decides overlaps: a 16-digit
    card without separators loses its last ten digits to PHONE and six digits
    stay visible) or ``longest`` (the longest candidate wins, detection order
    among equals).

    The work is staged in separate projections so that every regex pass runs
    once per row: (1) whether a row can match, (2) the matches of each pattern,
    (3) their lengths with the gaps before them, only for rows where the pattern
    matched, (4) the entity structs with their running offsets, (5) greedy
    resolution and ordering. Higher-order functions evaluate their arguments
    without common-subexpression elimination, so inlining these steps would
    repeat the regex scans. Each stage is one projection (``withColumns``) to
    keep the plan small. They also run interpreted, so (4) and (5) use them only
    on texts with several matches.
    """
    # the text (and external entities) go through fixed scratch names, so one
    # set of built expressions serves every call
    ext = _EXT_SCRATCH if external_col is not None else None
    *stages, result = _entity_stages(_TEXT_SCRATCH, ext, priority, unicode, tuple(types) if types else None, candidates)
    staged = df.withColumn(_TEXT_SCRATCH, F.col(text_col))
    if ext:
        staged = staged.withColumn(ext, F.col(external_col))
    scratch = [_TEXT_SCRATCH] + ([ext] if ext else [])
    for stage in stages:
        staged = staged.withColumns(stage)
        scratch += stage
    return staged.withColumn(out_col, result).drop(*scratch)


@lru_cache(maxsize=64)
def _pii_outputs(text_col: str, ent_col: str) -> tuple:
    return redact_with(F.col(text_col), F.col(ent_col)), pii_metadata(F.col(ent_col))


def with_pii(df: DataFrame, text_col: str, prefix: str = "", external_col: str | None = None,
             priority: str = "reference", unicode: bool = True) -> DataFrame:
    """Add ``{prefix}entities``, ``{prefix}redacted`` and ``{prefix}pii`` (metadata)."""
    ent_name = f"{prefix}entities"
    out = with_entities(df, text_col, ent_name, external_col, priority, unicode)
    redacted, meta = _pii_outputs(text_col, ent_name)
    return out.withColumns({f"{prefix}redacted": redacted, f"{prefix}pii": meta})

