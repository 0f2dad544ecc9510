"""Column expressions on text: cleaning, terms, tokens, titles, limits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waxgraph import fixed


def blank_to_null(text: Column) -> Column:
    """Node tables keep one form of "nothing there": null."""
    return F.nullif(text, F.lit(""))


def csv_text(text: Column) -> Column:
    """Interchange form of an optional element: a missing tag is written as an
    empty string and a tag without text as null, the reverse of what the XML
    reader hands over."""
    return F.when(text.isNull(), F.lit("")).when(text != "", text)


def first_text(*texts: Column) -> Column:
    """First of the given texts that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(text) for text in texts])


def node_text(name: str = "name", title: str = "title") -> Column:
    """What a node is searched by: its name, or its title if it has no name."""
    return first_text(F.col(name), F.col(title))


def display_title(name: str = "name", title: str = "title") -> Column:
    return F.coalesce(node_text(name, title), F.lit(fixed.UNTITLED))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, fixed.SPACE_CLASS + "+", " "))


def clean_term(text: Column, width: int = fixed.TERM_MAX) -> Column:
    """Search text without reserved characters, squeezed and cut to ``width``."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), fixed.RESERVED_CLASS, " ")
    return F.substring(squeeze(plain), 1, width)


def terms(text: Column) -> Column:
    """Lower-cased words between white space; repeats stay."""
    words = F.split(F.lower(text), fixed.SPACE_CLASS + "+")
    return F.filter(words, lambda word: word != "")


def tokens(text: Column) -> Column:
    """Index tokens: lower-cased runs of letters and digits; repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN), F.lit(0))


def has_text(text: Column) -> Column:
    """True where something other than white space is present."""
    return F.coalesce(text.rlike(fixed.NON_SPACE_CLASS), F.lit(False))


def strip(text: Column) -> Column:
    """White space of any sort removed from both ends only."""
    ends = f"^{fixed.SPACE_CLASS}+|{fixed.SPACE_CLASS}+$"
    return F.regexp_replace(text, ends, "")


def clamp_limit(
    raw: Column, default: int = fixed.LIMIT_DEFAULT, top: int = fixed.LIMIT_MAX
) -> Column:
    """Whole number between 1 and ``top`` from free text, ``default`` if it is none.

    Numbers too long for a decimal still clamp by their sign.
    """
    text = strip(raw)
    number = text.try_cast("decimal(38,0)")
    bounded = F.greatest(F.lit(1), F.least(F.lit(top), number)).cast("int")
    by_sign = F.when(text.startswith("-"), F.lit(1)).otherwise(F.lit(top))
    clamped = F.when(number.isNull(), by_sign).otherwise(bounded)
    return F.when(text.rlike("^[+-]?[0-9]+$"), clamped).otherwise(F.lit(default))


def clamp_suggest_limit(raw: Column) -> Column:
    return clamp_limit(raw, fixed.SUGGEST_DEFAULT, fixed.SUGGEST_MAX)


def seed_count(limit: Column) -> Column:
    """A search spends a quarter of its limit on seeds, one at least."""
    return F.greatest(F.lit(1), F.floor(limit / 4).cast("int"))


def space_of(kind: Column) -> Column:
    """Id space of a kind; Artist and Group share one."""
    chain = F.when(kind == fixed.KINDS[0], fixed.SPACE_OF_KIND[fixed.KINDS[0]])
    for name in fixed.KINDS[1:]:
        chain = chain.when(kind == name, fixed.SPACE_OF_KIND[name])
    return chain


def type_rank(edge_type: Column, order: tuple[str, ...] = fixed.EDGE_TYPES) -> Column:
    """Position of an edge type in the budget order; unknown types come last."""
    chain = F.when(edge_type == order[0], 0)
    for rank, name in enumerate(order[1:], 1):
        chain = chain.when(edge_type == name, rank)
    return chain.otherwise(len(order))


def numeric_id(text: Column) -> Column:
    return text.try_cast("bigint")


def subtitle(kind: Column, artists: Column, labels: Column, year: Column, profile: Column) -> Column:
    """Second line of a suggestion. ``artists`` and ``labels`` are arrays."""
    tied_to = F.concat_ws(
        " · ",
        blank_to_null(F.array_join(artists, ", ")),
        blank_to_null(F.array_join(labels, ", ")),
        blank_to_null(year),
    )
    release = first_text(tied_to, kind)
    return F.when(kind == "Release", release).otherwise(first_text(profile, kind))


def node_size(degree: Column) -> Column:
    """Radius that grows fast up to the knee and slowly after it."""
    scale = fixed.SIZE_AT_KNEE * (fixed.SIZE_MAX - fixed.SIZE_MIN)
    growth = F.log2(F.greatest(degree, F.lit(0)) + 1) * scale / F.log2(F.lit(fixed.SIZE_KNEE + 1))
    return F.least(F.lit(fixed.SIZE_MAX), F.lit(fixed.SIZE_MIN) + growth)


def site_path(kind: Column) -> Column:
    chain = F.when(kind == fixed.KINDS[0], fixed.SITE_PATHS[fixed.KINDS[0]])
    for name in fixed.KINDS[1:]:
        chain = chain.when(kind == name, fixed.SITE_PATHS[name])
    return chain


def site_link(site: str, kind: Column, native_id: Column) -> Column:
    """Page of a node on the catalogue site; null without a path or an id."""
    return F.concat(F.lit(site.rstrip("/") + "/"), site_path(kind), F.lit("/"), native_id)


def human_bytes(size: Column) -> Column:
    """Byte count for reading: a dash for nothing, else one decimal and a unit."""
    chain = F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("-"))
    chain = chain.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        shown = F.format_string("%.1f " + unit, size / float(1024**power))
        chain = chain.when(size < 1024 ** (power + 1), shown)
    return chain.otherwise(F.format_string("%.1f TiB", size / float(1024**4)))


def human_seconds(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    hours = F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60))
    minutes = F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)
    return (
        F.when(whole.isNull(), F.lit("-"))
        .when(whole < 60, F.format_string("%ds", whole))
        .when(whole < 3600, minutes)
        .otherwise(hours)
    )
