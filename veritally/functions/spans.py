"""Spans of one text as array columns: find, merge, number, mask, restore.

A text and its spans live in one row, so masking a request never shuffles. Offsets are
0-based, half-open, and count code points, as `substring` and `length` do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types masked by default and the score a detection needs.
ENTITIES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "LOCATION", "US_SSN")
SCORE_THRESHOLD = 0.4

V4_ADDRESS = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Patterns keep to what Java's and RE2's dialects share. Scores order overlapping finds.
PATTERNS: dict[str, tuple[str, float]] = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),
    "CREDIT_CARD": (r"\b(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})\b", 0.9),
    "IP_ADDRESS": (
        rf"\b(?:{V4_ADDRESS}"
        r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})\b",
        0.6,
    ),
    "US_SSN": (r"\b[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}\b", 0.85),
    "PHONE_NUMBER": (r"(?:(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4})\b", 0.75),
}

# What a text must contain before a pattern is tried on it.
NEEDS = {"EMAIL_ADDRESS": "@"}

# Where matches lie: whole runs of the characters that the matches of these types consist of. One search for the runs
# stands for a search of the text per pattern; each run is then tried with the characters beside it, on which boundaries depend.
# Single characters in a class are looked up in a table, ranges are compared one by one.
RUNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"[+(0123456789][0123456789 ().+-]{6,}+", ("CREDIT_CARD", "US_SSN", "PHONE_NUMBER")),
    (r"\p{XDigit}{1,4}+[.:][\p{XDigit}.:]{2,}+", ("IP_ADDRESS",)),
)

# What every weak number holds.
DIGITS = "[0-9]{9}"

# What every address with colons holds, other than one that begins with two; without it addresses are runs of digits and dots.
COLONS = r":(?::(?<=[0-9A-Fa-f]::)|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:)[0-9A-Fa-f]"

# The two sides of an @, each in the text between two of them.
LOCAL_END, DOMAIN_START = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\z", r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

# Patterns without a boundary: a match can only be the first copy of itself after the last.
UNBOUNDED = ("EMAIL_ADDRESS",)
FEW_MATCHES = 8

# Stretches of a text that are searched after and before an @.
DOMAIN_CHARS, LOCAL_CHARS = 256, 64

# Weak patterns: what they find is a span only beside one of the words (then with the score that context gives),
# or, without words, only where no word character or colon stands before it.
CONTEXT_BEFORE, CONTEXT_AFTER = 60, 30
CONTEXT_SCORE = 0.4
WEAK: tuple[tuple[str, str, float, str], ...] = (
    ("US_SSN", r"\b[0-9]{9}\b", 0.05, r"\b(?:ssns?|social security|security number|tax ?id|taxpayer)\b"),
    ("PHONE_NUMBER", r"\b[0-9]{10}\b", 0.05, r"\b(?:phone|telephone|mobile|cell|call|tel|fax)\b"),
    ("IP_ADDRESS", r"::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}\b", 0.6, ""),
)

SPAN_SQL = "struct<start: int, end: int, entity_type: string, score: double>"


PART_SQL = "struct<gap: string, surface: string, entity_type: string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it as often as `body` likes.

    Inside a lambda nothing is shared between uses of one expression, and an outer expression
    is evaluated anew for every element; a bound variable is not.
    """
    return F.transform(F.array(value), body)[0]


def passes_luhn(number: Column) -> Column:
    """The check digit rule of card numbers, over the digits of a text."""
    return F.call_function("luhn_check", F.regexp_replace(number, "[^0-9]", ""))


def pattern_spans(text: Column, entity_type: str, check_luhn: bool = True) -> Column:
    """Every match of one entity's pattern, with its place.

    A pattern with word boundaries may reject an earlier copy of a match, so there the text is
    split at the pattern, and the running length of pieces and matches gives the offsets.
    Without boundaries an earlier copy would itself have matched, and looking the match up
    after the last one is enough.
    """
    pattern, score = PATTERNS[entity_type]
    spans = _placed(text, pattern, score, entity_type)
    if entity_type in NEEDS:
        spans = F.when(text.contains(NEEDS[entity_type]), spans).otherwise(F.array().cast(f"array<{SPAN_SQL}>"))
    if entity_type == "CREDIT_CARD" and check_luhn:
        return F.filter(spans, lambda s: passes_luhn(surface_form(text, s)))
    return spans


def weak_spans(text: Column, entity_type: str, pattern: str, score: float, words: str) -> Column:
    """Matches of a weak pattern, with the score that the text around each gives it."""
    if not words:
        # Few texts hold two colons in a row, so most are never tried, and none before the first two. No two matches overlap, so what stands
        # before one may be asked at once.
        own = f"::(?<![0-9A-Za-z_:]::){pattern.removeprefix('::')}"

        def searched(before: Column) -> Column:
            rest = F.substring(text, before + 1, F.length(text))
            return F.when(before >= 0, let(rest, lambda t: _moved(_placed(t, own, score, entity_type), before))).otherwise(F.array().cast(f"array<{SPAN_SQL}>"))

        # One character before the colons goes with them.
        return let(F.position(F.lit("::"), text), lambda at: let(F.when(at > 0, F.greatest(at - 2, F.lit(0))).otherwise(-1), searched))
    return _in_context(text, _placed(text, pattern, score, entity_type), score, words)


def _in_context(text: Column, spans: Column, score: float, words: str) -> Column:
    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_BEFORE, F.lit(0))
        around = F.substring(text, first + 1, s["end"] - first + CONTEXT_AFTER)
        return s.withField("score", F.when(around.rlike(f"(?i){words}"), F.lit(max(CONTEXT_SCORE, score))).otherwise(s["score"]))

    return F.transform(spans, scored)


def _moved(spans: Column, offset: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset))


def _placed(text: Column, pattern: str, score: float, entity_type: str) -> Column:
    # The run before an @ cannot hold one, so giving characters back is useless work.
    pattern = pattern.replace("]+@", "]++@", 1)
    empty = F.array().cast(f"array<{SPAN_SQL}>")

    def step(acc: Column, start: Column, match: Column) -> Column:
        end = start + F.length(match)
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(entity_type).alias("entity_type"), F.lit(score).alias("score")
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def place(found: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        by_pieces = F.aggregate(
            F.arrays_zip(found.alias("m"), between.alias("p")),
            begin,
            lambda acc, z: let(acc["at"] + F.length(z["p"]), lambda start: step(acc, start, z["m"])),
            lambda acc: acc["spans"],
        )
        if entity_type not in UNBOUNDED:
            # A single match without a second copy of itself can only be where its text is.
            alone = let(F.position(found[0], text), lambda at: F.when(F.position(found[0], text, at + 1) == 0, step(begin, at - 1, found[0])["spans"]))
            return F.coalesce(F.when(F.size(found) == 1, alone), by_pieces)
        by_lookup = F.aggregate(
            found,
            begin,
            lambda acc, m: let(F.position(m, text, acc["at"] + 1) - 1, lambda start: step(acc, start, m)),
            lambda acc: acc["spans"],
        )
        # Every lookup walks the text from its start, so many of them cost more than a split.
        return F.when(F.size(found) <= FEW_MATCHES, by_lookup).otherwise(by_pieces)

    searched = _beside_at(text) if NEEDS.get(entity_type) == "@" else text
    return let(
        F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, place(found)).otherwise(empty),
    )


def _beside_at(text: Column) -> Column:
    """The text with what lies far from every @ left out: it holds the same addresses in the same order.

    A run beside an @ that is longer than the stretch kept keeps its whole piece.
    """

    def kept(piece: Column) -> Column:
        head, tail = F.substring(piece, 1, DOMAIN_CHARS), F.substring(piece, -LOCAL_CHARS, LOCAL_CHARS)
        ends = let(head, lambda h: let(tail, lambda t: F.when(h.rlike("[^A-Za-z0-9.-]") & t.rlike("[^A-Za-z0-9._%+-]"), F.concat(h, F.lit("\n"), t))))
        return F.when(F.length(piece) > DOMAIN_CHARS + LOCAL_CHARS, F.coalesce(ends, piece)).otherwise(piece)

    return F.array_join(F.transform(F.split(text, "@", -1), kept), "@")


def _addresses(text: Column) -> Column:
    """The spans of `pattern_spans(text, "EMAIL_ADDRESS")`, found from each @ outwards.

    An address begins where the run before its @ does, or where the address before it ends.
    """
    score = PATTERNS["EMAIL_ADDRESS"][1]
    empty = F.array().cast(f"array<{SPAN_SQL}>")

    def local_length(piece: Column) -> Column:
        end = lambda t: F.length(F.regexp_extract(t, LOCAL_END, 0))
        return let(end(F.right(piece, F.lit(LOCAL_CHARS))), lambda n: F.when(n < LOCAL_CHARS, n).otherwise(end(piece)))

    def domain_length(piece: Column) -> Column:
        start = lambda t: F.length(F.regexp_extract(t, DOMAIN_START, 0))
        return let(F.left(piece, F.lit(DOMAIN_CHARS)), lambda head: F.when(head.rlike("[^A-Za-z0-9.-]"), start(head)).otherwise(start(piece)))

    def step(acc: Column, z: Column) -> Column:
        def placed(sign: Column) -> Column:
            def spans(start: Column, domain: Column) -> Column:
                end = sign + 1 + domain
                span = F.struct(start.alias("start"), end.alias("end"), F.lit("EMAIL_ADDRESS").alias("entity_type"), F.lit(score).alias("score"))
                hit = (domain > 0) & (start < sign)
                return F.struct(
                    (sign + 1).alias("next"), F.when(hit, end).otherwise(acc["at"]).alias("at"),
                    F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
                )

            return let(F.greatest(acc["at"], sign - local_length(z["b"])), lambda start: let(domain_length(z["a"]), lambda domain: spans(start, domain)))

        return let(acc["next"] + F.length(z["b"]), placed)

    def searched(pieces: Column) -> Column:
        signs = F.size(pieces) - 1
        zipped = F.arrays_zip(F.slice(pieces, 1, signs).alias("b"), F.slice(pieces, 2, signs).alias("a"))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    return F.when(text.contains("@"), let(F.split(text, "@", -1), searched)).otherwise(empty)


def _in_runs(text: Column, run: str, find: Callable[[Column, Column], Column]) -> Column:
    """The spans that `find(part, offset)` gives for the runs of a text; a part is a run with one character on either side."""
    empty = F.array().cast(f"array<{SPAN_SQL}>")

    def searched(runs: Column, between: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            def after(gap: Column) -> Column:
                start = acc["at"] + gap
                part = F.concat(F.substring(z["p"], gap, F.lit(1)), z["m"], F.substring(z["q"], 1, 1))
                found = let(part, lambda t: find(t, start - F.least(gap, F.lit(1))))
                return F.struct((start + F.length(z["m"])).alias("at"), F.concat(acc["spans"], found).alias("spans"))

            return let(F.length(z["p"]), after)

        zipped = F.arrays_zip(runs.alias("m"), F.slice(between, 1, F.size(runs)).alias("p"), F.slice(between, 2, F.size(runs)).alias("q"))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    return let(
        F.regexp_extract_all(text, F.lit(run), F.lit(0)),
        lambda runs: F.when(F.size(runs) > 0, let(F.split(text, run, -1), lambda between: searched(runs, between))).otherwise(empty),
    )


def detect_patterns(
    text: Column, entities: Sequence[str] = ENTITIES, score_threshold: float = SCORE_THRESHOLD
) -> Column:
    """Raw (unmerged) spans of the pattern types among `entities`, in text order."""
    if not 0.0 <= score_threshold <= 1.0:
        raise ValueError(f"a detection score lies in [0, 1]; got the threshold {score_threshold!r}")
    wanted = [e for e in PATTERNS if e in entities and PATTERNS[e][1] >= score_threshold]
    empty = F.array().cast(f"array<{SPAN_SQL}>")
    weak = [w for w in WEAK if w[0] in entities and max(w[2], CONTEXT_SCORE if w[3] else w[2]) >= score_threshold]

    def in_part(kinds: Sequence[str]) -> Callable[[Column, Column], Column]:
        def find(part: Column, offset: Column) -> Column:
            own = [_moved(pattern_spans(part, e), offset) for e in wanted if e in kinds]
            unsure = [_in_context(text, _moved(_placed(part, p, score, e), offset), score, words) for e, p, score, words in weak if e in kinds and words]
            if unsure:
                own.append(F.when(part.rlike(DIGITS), F.concat(*unsure)).otherwise(empty))
            return F.concat(*own)

        return find

    (numbers, of_numbers), (addresses, of_addresses) = RUNS
    with_ip = "IP_ADDRESS" in wanted

    def in_numbers(colons: Column) -> Callable[[Column, Column], Column]:
        def find(part: Column, offset: Column) -> Column:
            own = in_part(of_numbers)(part, offset) if asked else empty
            if not with_ip:
                return own
            plain = _moved(_placed(part, rf"\b{V4_ADDRESS}\b", PATTERNS["IP_ADDRESS"][1], "IP_ADDRESS"), offset)
            return F.concat(own, F.when(~colons & part.contains("."), plain).otherwise(empty))

        return find

    asked = any(e in of_numbers for e in [*wanted, *(w[0] for w in weak)])
    found = [_addresses(text)] if "EMAIL_ADDRESS" in wanted else []
    if with_ip:
        # Where an address may have colons, both kinds are searched together, since one may begin within the other.
        found += [let(text.rlike(COLONS), lambda colons: F.concat(
            _in_runs(text, numbers, in_numbers(colons)), F.when(colons, _in_runs(text, addresses, in_part(of_addresses))).otherwise(empty)))]
    elif asked:
        found.append(_in_runs(text, numbers, in_numbers(F.lit(False))))
    found += [weak_spans(text, e, p, score, words) for e, p, score, words in weak if not words]
    if weak:
        found = [F.filter(f, lambda s: s["score"] >= score_threshold) for f in found]
    if not found:
        return empty
    return F.coalesce(F.sort_array(F.concat(*found)), empty)


def surface_form(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def merge_spans(spans: Column) -> Column:
    """Merge overlapping spans; touching ones stay apart.

    A merged span keeps the type of its best score, the earliest on a tie.
    """
    empty = F.array().cast(f"array<{SPAN_SQL}>")

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            F.when(s["score"] > last["score"], s["entity_type"]).otherwise(last["entity_type"]).alias("entity_type"),
            F.greatest(last["score"], s["score"]).alias("score"),
        )
        overlaps = (F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(
            F.concat(acc, F.array(s))
        )

    def merged(found: Column) -> Column:
        # Neighbours in order that do not overlap are the rule, and then nothing has to be sorted or folded.
        neighbours = F.sequence(F.lit(1), F.size(found) - 1)
        apart = F.forall(neighbours, lambda i: (F.get(found, i)["start"] >= F.get(found, i - 1)["end"]) & (F.get(found, i)["start"] > F.get(found, i - 1)["start"]))
        return F.when(F.size(found) < 2, found).when(apart, found).otherwise(F.aggregate(F.array_sort(found), empty, fold))

    return let(spans, merged)


def keep_in_range(text: Column, spans: Column) -> Column:
    """Drop spans that are empty or reach outside the text."""
    return F.filter(
        spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))
    )


def cut_at(text: Column, spans: Column) -> Column:
    """A text in pieces: per span the text before it, its surface and type; then the rest.

    `spans` are in order and do not overlap.
    """

    # A place in a text is reached by walking there, so all but the first gap are taken from where the first span begins.
    def pieces(found: Column, first: Column, tail: Column) -> Column:
        before = lambda i: F.get(found, i - 1)["end"]
        parts = F.transform(
            found,
            lambda s, i: F.struct(
                F.when(i == 0, F.substring(text, F.lit(1), first)).otherwise(F.substring(tail, before(i) - first + 1, s["start"] - before(i))).alias("gap"),
                F.substring(tail, s["start"] - first + 1, s["end"] - s["start"]).alias("surface"),
                s["entity_type"].alias("entity_type"),
            ),
        )
        rest = F.substring(tail, F.element_at(found, -1)["end"] - first + 1, F.length(tail))
        return F.struct(parts.alias("parts"), rest.alias("rest"))

    def cut(found: Column) -> Column:
        first = F.get(found, F.lit(0))["start"]
        whole = F.struct(F.array().cast(f"array<{PART_SQL}>").alias("parts"), text.alias("rest"))
        cut_from = lambda at: let(F.substring(text, at + 1, F.length(text)), lambda tail: pieces(found, at, tail))
        return F.when(F.size(found) > 0, let(first, cut_from)).otherwise(whole)

    return let(spans, cut)


def fill_in(cut: Column, placeholders: Column) -> Column:
    """The text of `cut_at` with a placeholder for every surface form."""
    filled = F.transform(cut["parts"], lambda p: F.concat(p["gap"], F.element_at(placeholders, p["surface"])))
    return F.concat(F.array_join(filled, ""), cut["rest"])


def apply_mask(text: Column, spans: Column, placeholders: Column) -> Column:
    """The text with every span replaced by the placeholder of its surface form."""
    return let(cut_at(text, spans), lambda cut: fill_in(cut, placeholders))


FORM_SQL = "struct<surface: string, entity_type: string>"


def first_forms(forms: Column) -> Column:
    """Distinct surface forms in order; a form keeps the type it first appears with."""

    def joined(f: Column) -> Column:
        return F.concat(f["surface"], F.lit("\u0000"), f["entity_type"])

    def parted(x: Column) -> Column:
        kind = F.substring_index(x, "\u0000", -1)
        return F.struct(F.substring(x, F.lit(1), F.length(x) - F.length(kind) - 1).alias("surface"), kind.alias("entity_type"))

    def one_type_each(pairs: Column) -> Column:
        firsts = F.aggregate(
            pairs,
            F.array().cast(f"array<{FORM_SQL}>"),
            lambda acc, f: F.when(F.exists(acc, lambda a: a["surface"] == f["surface"]), acc).otherwise(F.concat(acc, F.array(f))),
        )
        # The fold is quadratic; it is needed only when some form came with two types.
        plain = F.size(F.array_distinct(F.transform(pairs, lambda f: f["surface"]))) == F.size(pairs)
        return F.when(plain, pairs).otherwise(firsts)

    return let(F.transform(F.array_distinct(F.transform(forms, joined)), parted), one_type_each)


def number_forms(texts: Column, forms: Column) -> Column:
    """(surface, placeholder) of every distinct form, numbered per type by first appearance.

    Numbers whose placeholder already stands in one of the texts are passed over.
    """
    in_texts = F.regexp_extract_all(F.array_join(texts, "\n"), F.lit(r"<[A-Z0-9_]+_[1-9][0-9]{0,8}>"), F.lit(0))

    def per_type(kind: Column, first: Column, taken: Column) -> Column:
        def numbered(own: Column) -> Column:
            wanted = F.transform(
                F.sequence(F.lit(1), F.size(own) + F.size(taken)),
                lambda n: F.concat(F.lit("<"), kind, F.lit("_"), n.cast("string"), F.lit(">")),
            )
            return let(
                F.array_except(wanted, taken),
                lambda free: F.transform(own, lambda f, i: F.struct(f["surface"].alias("surface"), F.get(free, i).alias("placeholder"))),
            )

        return let(F.filter(first, lambda f: f["entity_type"] == kind), numbered)

    def over_types(first: Column, taken: Column) -> Column:
        kinds = F.array_distinct(F.transform(first, lambda f: f["entity_type"]))
        return F.flatten(F.transform(kinds, lambda kind: per_type(kind, first, taken)))

    return let(first_forms(forms), lambda first: let(in_texts, lambda taken: over_types(first, taken)))


PLACEHOLDER = r"<[A-Z0-9_]+_[0-9]+>"


def _each_placeholder(text: Column, change: Callable[[Column], Column]) -> Column:
    """The text with every placeholder changed, in one pass; names may be of any length."""
    between = F.split(text, PLACEHOLDER)
    found = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), change)
    return F.array_join(F.zip_with(between, found, lambda t, p: F.concat(t, F.coalesce(p, F.lit("")))), "")


def restore_text(text: Column, mapping: Column) -> Column:
    """Placeholders back to their originals in one pass, so replacements never cascade."""
    return _each_placeholder(text, lambda p: F.coalesce(F.try_element_at(mapping, p), p))


def highlight_placeholders(text: Column, mapping: Column, marker: str = "**") -> Column:
    """Wrap the placeholders of a mapping in a marker."""
    return _each_placeholder(text, lambda p: F.when(F.map_contains_key(mapping, p), F.concat(F.lit(marker), p, F.lit(marker))).otherwise(p))
