"""PII masking of requests and the quality of span detection, as table operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import spans as S
from veritally.functions.stats import f1_score, ratio_or_one
from veritally.functions.text import safe_entity_type
from veritally.operators.names import find_names, name_finder
from veritally.scale import HOT_KEY_ROWS, SMALL_SIDE_ROWS, skew_join
from veritally.session import materialize

CHUNK_CHARS = 32_768
"""Width of the stretches of text in which overlapping runs are found first."""


# -- detection --------------------------------------------------------------------------------


def detect_pii(
    docs: DataFrame,
    entities: Sequence[str] = S.ENTITIES,
    score_threshold: float = S.SCORE_THRESHOLD,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Spans as rows: (doc_id, start, end, entity_type, score), unmerged.

    `docs` has doc_id and text. Pattern types come from expressions on the text; names and
    places from a `gazetteer(surface, entity_type)` if one is given.
    """
    found = docs.select("doc_id", F.explode(S.detect_patterns(F.col("text"), entities, score_threshold)).alias("s")).select(
        "doc_id", "s.start", "s.end", "s.entity_type", "s.score"
    )
    if gazetteer is None:
        return found
    return found.unionByName(detect_gazetteer(docs, gazetteer.filter(F.col("entity_type").isin(*entities))))


def detect_gazetteer(docs: DataFrame, gazetteer: DataFrame, score: float = 0.85, max_rows: int = SMALL_SIDE_ROWS, keep_surface: bool = False) -> DataFrame:
    """Spans of listed names, of any number of words; a list over `max_rows` is cut in shards."""
    kept = ["surface"] if keep_surface else []
    return find_names(docs, gazetteer, max_rows).select("doc_id", "start", "end", "entity_type", F.lit(score).alias("score"), *kept)


def detect_with(
    docs: DataFrame, detector_factory: Callable[[], Callable[[str], Sequence[tuple[int, int, str, float]]]],
    score_threshold: float = S.SCORE_THRESHOLD,
) -> DataFrame:
    """Spans from a user's detector; the factory runs once per task, so a model loads once."""
    kind = f"array<{S.SPAN_SQL}>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = detector_factory()
        for texts in batches:
            yield pd.Series(
                [
                    [{"start": int(a), "end": int(b), "entity_type": str(t), "score": float(p)} for a, b, t, p in detector(text)]
                    if text
                    else []
                    for text in texts
                ]
            )

    found = docs.select("doc_id", "text", run("text").alias("_s"))
    exploded = found.select("doc_id", F.explode(S.keep_in_range(F.col("text"), F.col("_s"))).alias("s"))
    return exploded.select(
        "doc_id", "s.start", "s.end", safe_entity_type(F.col("s.entity_type")).alias("entity_type"), "s.score"
    ).filter(F.col("score") >= score_threshold)


# -- merging and matching span tables ---------------------------------------------------------


def _local_runs(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_chunk`, the stretch of text in which a span begins, and `_run`, the start of its overlapping run as far as the stretch alone tells."""
    chunk = spans.withColumn("_chunk", F.floor(F.col("start") / CHUNK_CHARS))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = chunk.withColumn("_opens", F.when(reach.isNull() | (F.col("start") >= reach), F.col("start")))
    return opens.withColumn("_run", F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


def _joined_runs(runs: DataFrame, keys: Sequence[str], out: str, payload: Sequence[str]) -> DataFrame:
    """Runs of stretches as runs of whole texts: `out` is the start of the run that each one belongs to.

    A stretch hands on two numbers, where its last run begins and ends; what it makes of the open run
    before it follows from those, so one scan over the stretches of a text is enough. A run that begins
    before the reach of what came earlier belongs to the run that was open. The runs of a stretch travel as one array,
    of at most as many entries as the stretch has characters.
    """
    packed = runs.groupBy(*keys, "_chunk").agg(
        F.collect_list(F.struct("_run", "_end", *payload)).alias("_runs"), F.max("_run").alias("_last"), F.max("_end").alias("_top")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    reached = packed.withColumn("_reach", F.max("_top").over(before))
    opened = F.when(F.col("_reach").isNull() | (F.col("_last") >= F.col("_reach")), F.col("_last"))
    carried = reached.withColumn("_opened", opened).withColumn("_open", F.max("_opened").over(before))
    each = carried.select(*keys, "_reach", "_open", F.explode("_runs").alias("_r"))
    own = F.col("_reach").isNull() | (F.col("_r._run") >= F.col("_reach"))
    return each.select(*keys, F.when(own, F.col("_r._run")).otherwise(F.col("_open")).alias(out), F.col("_r._end").alias("_end"), *[F.col(f"_r.{c}").alias(c) for c in payload])


def span_islands(spans: DataFrame, keys: Sequence[str] = ("doc_id",), out: str = "island") -> DataFrame:
    """Number overlapping runs of spans by the start of the run.

    Runs are found within stretches of text first and then joined across them: one read, one shuffle by
    (text, stretch) and one by text. The spans of a run travel together, as the matching that follows needs them.
    """
    keys = list(keys)
    others = [c for c in spans.columns if c not in keys]
    runs = _local_runs(spans, keys).groupBy(*keys, "_chunk", "_run").agg(F.max("end").alias("_end"), F.collect_list(F.struct(*others)).alias("_spans"))
    joined = _joined_runs(runs, keys, out, ["_spans"])
    return joined.select(*keys, out, F.explode("_spans").alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others], out)


def merge_overlapping_spans(spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merge overlapping span rows; the best score names the type, the earliest on a tie."""
    keys = list(keys)
    best = F.struct((-F.col("score")).alias("minus"), "start", "end", "entity_type")
    # A run is one row from here on, however many spans it holds.
    runs = _local_runs(spans, keys).groupBy(*keys, "_chunk", "_run").agg(
        F.max("end").alias("_end"), F.min(best).alias("_best"), F.max("score").alias("score")
    )
    return (
        _joined_runs(runs, keys, "start", ["_best", "score"])
        .groupBy(*keys, "start")
        .agg(F.max("_end").alias("end"), F.min("_best").alias("_best"), F.max("score").alias("score"))
        .select(*keys, "start", "end", F.col("_best.entity_type").alias("entity_type"), "score")
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 256) -> DataFrame:
    """Pairs of spans of one document that share a character: strict interval overlap.

    Spans are put in the stretches of text they touch and joined on (document, stretch), so
    only neighbours are compared; a pair is kept in the first stretch both touch.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
        return df.select(
            key,
            F.struct("start", "end", "entity_type").alias(side),
            lo.alias(f"_{side}_lo"),
            F.explode(F.sequence(lo, hi)).alias("_bin"),
        )

    joined = binned(left, "l").join(binned(right, "r"), [key, "_bin"])
    return joined.filter(
        (F.col("l.start") < F.col("r.end"))
        & (F.col("r.start") < F.col("l.end"))
        & (F.col("_bin") == F.greatest("_l_lo", "_r_lo"))
    ).select(key, "l", "r")


def match_spans(expected: DataFrame, detected: DataFrame, typed: bool = False) -> DataFrame:
    """Pair detections with expected spans one to one: matched, missed and spurious rows.

    Each detection, in its order, takes the first free expected span it overlaps. Spans of
    different overlapping runs cannot meet, so the sequential rule is applied per run, which
    is a handful of spans, and never per document. `ord` gives the order on each side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", "start", "end", "entity_type", "ord", F.lit(name).alias("side"))

    both = span_islands(side(expected, "expected").unionByName(side(detected, "detected")))
    item = F.struct("ord", "start", "end", "entity_type")
    runs = both.groupBy("doc_id", "island").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "expected", item))).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "detected", item))).alias("d"),
    )
    kind = "struct<ord: bigint, start: int, end: int, entity_type: string>"
    outcome = f"array<struct<outcome: string, e: {kind}, d: {kind}>>"
    same_type = "and f.entity_type = x.entity_type" if typed else ""
    hit = f"get(filter(acc.free, f -> x.start < f.end and f.start < x.end {same_type}), 0)"
    folded = F.expr(
        f"""
        aggregate(
          transform(d, x -> cast(x as {kind})),
          struct(transform(e, x -> cast(x as {kind})) as free, cast(array() as {outcome}) as done),
          (acc, x) -> struct(
            case when {hit} is null then acc.free else filter(acc.free, f -> f.ord <> ({hit}).ord) end as free,
            concat(acc.done, array(struct(
              case when {hit} is null then 'spurious' else 'matched' end as outcome, {hit} as e, x as d))) as done),
          acc -> concat(acc.done, transform(acc.free, f -> struct('missed' as outcome, f as e, cast(null as {kind}) as d))))
        """
    )
    return runs.select("doc_id", F.explode(folded).alias("m")).select(
        "doc_id",
        "m.outcome",
        F.col("m.e.start").alias("expected_start"),
        F.col("m.e.end").alias("expected_end"),
        F.col("m.e.entity_type").alias("expected_type"),
        F.col("m.d.start").alias("detected_start"),
        F.col("m.d.end").alias("detected_end"),
        F.col("m.d.entity_type").alias("detected_type"),
    )


def pii_detection_quality(matches: DataFrame) -> DataFrame:
    """Counts and rates per entity type and for ALL; the types add up to ALL.

    A caught or missed span counts under its label's type, a spurious one under the
    detector's.
    """
    named = matches.select("outcome", F.coalesce("expected_type", "detected_type").alias("entity_type"))
    rolled = named.rollup("entity_type").agg(
        F.grouping("entity_type").alias("_all"),
        F.count_if(F.col("outcome") == "matched").alias("true_positives"),
        F.count_if(F.col("outcome") == "spurious").alias("false_positives"),
        F.count_if(F.col("outcome") == "missed").alias("false_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    precision, recall = ratio_or_one(tp, tp + fp), ratio_or_one(tp, tp + fn)
    return rolled.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("entity_type")).alias("entity_type"),
        tp, fp, fn,
        (tp + fn).alias("support"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
    )


def detection_misses(matches: DataFrame, docs: DataFrame, with_context: bool = True, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Every missed span with its text, and the document it leaked from.

    The document is repeated for each of its misses; leave the context out where texts are
    long and misses many.
    """
    missed = matches.filter(F.col("outcome") == "missed").select("doc_id", "expected_start", "expected_end", "expected_type")
    # The join looks for hot keys first, so the misses are read twice; they are worked out once.
    found = skew_join(materialize(missed, "missed"), docs.select("doc_id", "text"), ["doc_id"], "inner", hot_rows).select(
        "doc_id",
        F.col("expected_type").alias("entity_type"),
        F.substring("text", F.col("expected_start") + 1, F.col("expected_end") - F.col("expected_start")).alias("surface"),
        F.col("text").alias("context"),
    )
    return found if with_context else found.drop("context")


def number_placeholders(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Placeholders for span rows: (batch_id, surface, entity_type, placeholder).

    `spans(batch_id, field_idx, start, surface, entity_type)` holds merged spans and
    `texts(batch_id, text)` the fields of each batch.
    """
    used = (
        texts.select(
            "batch_id", F.explode(F.regexp_extract_all("text", F.lit(r"<[A-Z0-9_]+_[1-9][0-9]{0,8}>"), F.lit(0))).alias("p")
        )
        .select(
            "batch_id",
            F.regexp_extract("p", r"^<([A-Z0-9_]+)_([1-9][0-9]*)>$", 1).alias("entity_type"),
            F.regexp_extract("p", r"^<([A-Z0-9_]+)_([1-9][0-9]*)>$", 2).cast("bigint").alias("n"),
        )
        .groupBy("batch_id", "entity_type")
        .agg(F.array_sort(F.collect_set("n")).alias("used"))
    )
    order = F.struct("field_idx", "start")
    forms = spans.groupBy("batch_id", "surface").agg(
        F.min(order).alias("_first"), F.min_by("entity_type", order).alias("entity_type")
    )
    # A request's distinct surface forms: bounded by the request.
    rank = F.row_number().over(Window.partitionBy("batch_id", "entity_type").orderBy("_first"))
    ranked = forms.withColumn("_rank", rank.cast("bigint")).join(used, ["batch_id", "entity_type"], "left")
    # The rank-th number not in `used`: step past every used number at or below it.
    number = F.aggregate(
        F.coalesce("used", F.array().cast("array<bigint>")), F.col("_rank"), lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc)
    )
    return ranked.select(
        "batch_id", "surface", "entity_type",
        F.concat(F.lit("<"), "entity_type", F.lit("_"), number.cast("string"), F.lit(">")).alias("placeholder"),
    )


# -- requests ---------------------------------------------------------------------------------


Detector = Callable[[str], Sequence[tuple[int, int, str, float]]]

DETECTED, NAMED = "_detected_spans", "_named_spans"
FIELD_SPANS = f"array<array<{S.SPAN_SQL}>>"


def request_fields() -> Column:
    """The texts of a request: question, answer, then contexts."""
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    return F.concat(F.array(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))), contexts)


def _with_spans(requests: DataFrame, factory: Callable[[], Detector], column: str) -> DataFrame:
    @F.pandas_udf(FIELD_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = factory()
        for fields in batches:
            yield pd.Series(
                [[[{"start": int(a), "end": int(b), "entity_type": str(t), "score": float(p)} for a, b, t, p in find(text or "")] for text in row] for row in fields]
            )

    return requests.withColumn(column, run(request_fields()))


def with_detector(requests: DataFrame, factory: Callable[[], Detector]) -> DataFrame:
    """Spans of a user's detector for every field, ready for `sanitize_requests`.

    The factory runs once per task, so a model loads once; requests arrive in Arrow batches.
    """
    return _with_spans(requests, factory, DETECTED)


def with_names(requests: DataFrame, gazetteer: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Spans of a list (surface, entity_type) for every field, ready for `sanitize_requests`.

    A list of up to SMALL_SIDE_ROWS names goes to every task; a larger one is cut in shards of that size, which the
    fields pass one by one. A bound that is given is kept: a larger list is an error then, and on a stream, where
    nothing can be gathered per request. Of a surface with several types the first in order counts.
    """
    bound = SMALL_SIDE_ROWS if max_rows is None else max_rows
    names = gazetteer.groupBy("surface").agg(F.min("entity_type").alias("entity_type"))
    rows = names.limit(bound + 1).collect()
    if len(rows) <= bound:
        return _with_spans(requests, name_finder({r.surface: r.entity_type for r in rows if r.surface}), NAMED)
    if max_rows is not None or requests.isStreaming:
        raise ValueError(f"the list has over {bound} names; without a bound, and on a table, they are searched in shards")
    return _with_sharded_names(requests, names.filter(F.length("surface") > 0), bound)


def _with_sharded_names(requests: DataFrame, names: DataFrame, bound: int, score: float = 0.85) -> DataFrame:
    """What `_with_spans` adds, for a list of any size.

    Requests are known by a digest of their fields, since equal fields have equal spans.
    """
    fields = F.transform(request_fields(), lambda t: F.coalesce(t, F.lit("")))
    keyed = requests.withColumn("_fields", F.sha2(F.concat_ws(",", F.transform(fields, lambda t: F.sha2(t, 256))), 256))
    texts = keyed.select("_fields", F.posexplode(fields).alias("_field", "text")).dropDuplicates(["_fields", "_field"])
    texts = texts.select(F.concat_ws(":", "_fields", "_field").alias("doc_id"), "text")
    hits = find_names(texts, names, bound)
    # In the order in which `name_finder` finds them.
    found = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("end", "start", "entity_type"))).alias("_s"))
    spans = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), F.lit(score).alias("score")))
    parts = F.split("doc_id", ":")
    by_field = found.select(parts[0].alias("_fields"), parts[1].cast("int").alias("_field"), spans.alias("_spans"))
    by_request = by_field.groupBy("_fields").agg(F.map_from_entries(F.collect_list(F.struct("_field", "_spans"))).alias("_found"))
    nothing = F.array().cast(f"array<{S.SPAN_SQL}>")
    placed = F.transform(request_fields(), lambda t, i: F.coalesce(F.try_element_at("_found", i), nothing)).cast(FIELD_SPANS)
    return skew_join(keyed, by_request, ["_fields"], "left").withColumn(NAMED, placed).drop("_fields", "_found")


def entities_to_mask(entities: Sequence[str] | None, others: bool) -> list[str]:
    """The types to mask: those asked for, by default all of ENTITIES that something here recognises.

    Asking for a type without anything that finds it is an error: what was promised to be
    masked would go out as it is.
    """
    known = [*S.ENTITIES] if others else [e for e in S.ENTITIES if e in S.PATTERNS]
    if entities is None:
        return known
    lost = [e for e in entities if e not in S.PATTERNS] if not others else []
    if lost:
        raise ValueError(f"nothing here recognises {', '.join(lost)}; add a detector or a list of names, or leave them out")
    return list(entities)


def sanitize_requests(
    requests: DataFrame,
    privacy_mode: str = "mask",
    entities: Sequence[str] | None = None,
    score_threshold: float = S.SCORE_THRESHOLD,
    detect: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Mask question, answer and contexts of each request as one batch.

    Spans come from the patterns, or from `detect` instead, and from what `with_detector` and
    `with_names` have added to the requests before. Adds `mapping` (placeholder to original),
    which the caller must drop before any sink. No shuffle: a request is one row. Any mode
    other than mask or off is an error, because a misspelt one must not unmask.
    """
    added = [c for c in (DETECTED, NAMED) if c in requests.columns]
    if privacy_mode not in ("mask", "off"):
        raise ValueError(f"privacy_mode must be 'mask' or 'off', got {privacy_mode!r}")
    if privacy_mode == "off":
        return requests.drop(*added).withColumn("mapping", F.create_map().cast("map<string,string>"))
    wanted = entities_to_mask(entities, bool(added) or detect is not None)
    finder = detect or (lambda t: S.detect_patterns(t, [e for e in wanted if e in S.PATTERNS], score_threshold))
    fields = request_fields()

    def others(t: Column, i: Column) -> list[Column]:
        def sound(c: str) -> Column:
            typed = F.transform(F.get(F.col(c), i), lambda s: s.withField("entity_type", safe_entity_type(s["entity_type"])))
            return F.filter(S.keep_in_range(t, typed), lambda s: s["entity_type"].isin(*wanted) & (s["score"] >= score_threshold))

        return [F.coalesce(sound(c), F.array().cast(f"array<{S.SPAN_SQL}>")) for c in added]

    def masked(texts: Column, cuts: Column) -> Column:
        def with_numbers(numbers: Column) -> Column:
            names = F.map_from_entries(numbers)
            return F.struct(
                S.let(names, lambda m: F.transform(cuts, lambda c: S.fill_in(c, m))).alias("texts"),
                F.map_from_entries(F.transform(numbers, lambda p: F.struct(p["placeholder"], p["surface"]))).alias("mapping"),
            )

        forms = F.flatten(
            F.transform(cuts, lambda c: F.transform(c["parts"], lambda p: F.struct(p["surface"].alias("surface"), p["entity_type"].alias("entity_type"))))
        )
        return S.let(S.number_forms(texts, forms), with_numbers)

    result = S.let(
        fields,
        lambda texts: S.let(
            F.transform(texts, lambda t, i: S.cut_at(t, S.merge_spans(F.concat(finder(t), *others(t, i)) if added else finder(t)))),
            lambda cuts: masked(texts, cuts),
        ),
    )
    kept = [c for c in requests.columns if c not in ("question", "answer", "contexts", *added)]
    return requests.select(*kept, result.alias("_r")).select(
        *kept,
        F.col("_r.texts")[0].alias("question"),
        F.col("_r.texts")[1].alias("answer"),
        F.slice("_r.texts", 3, F.size("_r.texts")).alias("contexts"),
        F.col("_r.mapping").alias("mapping"),
    )


def restore_verdicts(verdicts: Column, mapping: Column) -> Column:
    """Claims and reasons of a verdict array with their originals back, for local display."""
    return F.transform(
        verdicts,
        lambda v: F.struct(
            S.restore_text(v["claim"], mapping).alias("claim"),
            v["verdict"].alias("verdict"),
            S.restore_text(v["reason"], mapping).alias("reason"),
        ),
    )


def leak_check(sanitized: DataFrame, key: str = "sample_id") -> DataFrame:
    """Original values that still stand in an outbound field of their own request."""
    out = F.concat(F.array("question", "answer"), F.col("contexts"))
    # Counted inside the row: only what leaked is spread out, and no text is copied.
    leaked = S.let(
        out,
        lambda fields: F.filter(
            F.transform(
                F.map_values("mapping"),
                lambda v: F.struct(v.alias("value"), F.size(F.filter(fields, lambda t: t.contains(v))).alias("leaked_fields")),
            ),
            lambda x: x["leaked_fields"] > 0,
        ),
    )
    return sanitized.select(key, F.explode(leaked).alias("l")).select(key, "l.value", "l.leaked_fields")
