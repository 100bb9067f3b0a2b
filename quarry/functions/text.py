"""Text, number and keyword functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no target, template headings, number words of exports.
STOPWORDS = [
    "the", "for", "and", "a", "an", "of", "to", "in", "on", "with", "buy", "shop", "online", "sale",
    "collections", "collection", "products", "product", "pages", "page", "blogs", "blog", "www", "html", "index",
]
PROMISING = [
    "sale", "shop", "popular", "new", "new arrivals", "best sellers", "bestsellers", "collection", "collections",
    "clearance", "deals", "outlet", "gifts", "browse", "shop now", "learn more",
]
NULLISH = ["", "-", "--", "n/a", "na", "–", "—", "0", "+∞", "-∞", "∞", "∞%"]
MULTIPLIERS = [("mio.", 1_000_000), ("mio", 1_000_000), ("mln", 1_000_000), ("tis.", 1_000), ("tis", 1_000), ("m", 1_000_000), ("k", 1_000)]
DASHES = "[-‐‑‒–—―~]"
LEVELS = {
    "LOW": ["low", "nizka", "nizko", "nizek", "šibka", "sibka", "šibko", "sibko"],
    "MED": ["medium", "srednja", "srednje", "srednji", "srednja raven"],
    "HIGH": ["high", "visoka", "visoko", "visok", "močna", "mocna", "močno", "mocno"],
}
LEVEL_UNKNOWN = ["unknown", "neznano", "neznana", "--", "-"]

CONTENT_WORD = "[0-9a-zÀ-ɏ'-]+"


def singularize(word: Column) -> Column:
    """Naive: it only has to make wallet and wallets meet."""
    plural = (F.length(word) > 3) & word.rlike("s$") & ~word.rlike("(ss|us|is)$")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def target_tokens(text: Column) -> Column:
    """Words that say what something is about, in order, with repeats."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), singularize)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1))


def normalize_keyword(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")


def content_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CONTENT_WORD), F.lit(0))


def shingles(words: Column, n: int = 4) -> Column:
    """Windows of n words; the words themselves where there are fewer."""
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(words, lambda w: F.when(F.size(w) < n, w).otherwise(windows(w)))


def content_hash(words: Column) -> Column:
    return F.sha1(F.array_join(words, " "))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def promises_destination(anchor: Column, brand: Column) -> Column:
    """Whether an anchor text promises more than the home page."""
    t = F.lower(F.trim(anchor))
    own = (t == "") | ((brand != "") & F.contains(t, brand)) | t.isin("home", "homepage", "logo") | F.startswith(t, F.lit("back to"))
    words = "|".join(PROMISING)
    return ~own & t.rlike(rf"\d+\s*%|\bsave\b|\bcode\b|\b({words})\b")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(cleaned: Column) -> Column:
    """A cleaned number whose last separator is a decimal one, unless all are thousands."""
    dot, comma = F.contains(cleaned, F.lit(".")), F.contains(cleaned, F.lit(","))
    thousands = cleaned.rlike(r"^-?\d{1,3}(,\d{3})+$|^-?\d{1,3}(\.\d{3})+$")
    comma_last = cleaned.rlike(r",[^.,]*$")
    text = (
        F.when(dot & comma & comma_last, F.translate(F.translate(cleaned, ".", ""), ",", "."))
        .when(dot & comma, F.translate(cleaned, ",", ""))
        .when(thousands, F.translate(cleaned, ".,", ""))
        .otherwise(F.translate(cleaned, ",", "."))
    )
    return F.regexp_extract(text, r"^(-?(?:\d+\.?\d*|\.\d+))$", 1).try_cast("double")


def parse_number(text: Column) -> Column:
    """A number in any locale's form, or null."""
    trimmed = F.trim(F.translate(text, "\u00a0", " "))
    return let(trimmed, lambda t: F.when(~F.lower(t).isin(NULLISH), let(F.regexp_replace(t, r"[^\d.,\-]", ""), _number)))


def _with_multiplier(text: Column) -> Column:
    names = "|".join(s.replace(".", r"\.") for s, _ in MULTIPLIERS)

    def scaled(t: Column) -> Column:
        factor = F.element_at(F.create_map(*(F.lit(x) for pair in [*MULTIPLIERS, ("", 1)] for x in pair)), F.regexp_extract(t, f"({names})$", 1))
        return F.when(~t.isin(NULLISH), parse_number(F.regexp_replace(t, f"({names})$", "")) * factor)

    return let(F.lower(F.trim(F.translate(text, "\u00a0", " "))), scaled)


def parse_volume(text: Column) -> Column:
    """struct<minimum, maximum, mid, label, parsed>: ranges have their geometric mean as mid."""

    def read(label: Column) -> Column:
        parts = F.filter(F.split(label, rf"\s*{DASHES}\s*"), lambda p: F.trim(p) != "")
        numbers = F.transform(let(parts, lambda p: F.when(F.size(p) >= 2, F.array(F.get(p, F.lit(0)), F.element_at(p, -1))).otherwise(F.array(label))), _with_multiplier)
        return let(F.struct(label.alias("label"), F.lower(label).isin(NULLISH).alias("empty"), numbers.alias("n")), judged)

    def judged(x: Column) -> Column:
        parsed = ~x["empty"] & ~F.exists(x["n"], lambda n: n.isNull())
        low, high = F.array_min(x["n"]), F.array_max(x["n"])
        mid = F.when(F.size(x["n"]) == 1, low).when(low > 0, F.sqrt(low * high)).otherwise(high / 2)
        whole = lambda v: F.when(parsed, v.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(whole(low).alias("minimum"), whole(high).alias("maximum"), whole(F.bround(mid)).alias("mid"), x["label"].alias("label"), (x["empty"] | parsed).alias("parsed"))

    return let(F.trim(F.coalesce(text, F.lit(""))), read)


def parse_competition(text: Column) -> Column:
    """LOW, MED or HIGH, from a word in two languages or an index from 0 to 100."""
    words = F.create_map(*(F.lit(x) for level, known in LEVELS.items() for w in known for x in (w, level)))

    def level(t: Column) -> Column:
        number = F.when(~t.isin(LEVEL_UNKNOWN), parse_number(t))
        return F.coalesce(F.element_at(words, t), let(number, lambda n: F.when(n <= 33, "LOW").when(n <= 66, "MED").when(n.isNotNull(), "HIGH")))

    return let(F.lower(F.trim(text)), level)


def price_text(text: Column) -> Column:
    """The first number of a text as text: two decimals at most, no zeros at the end."""
    n = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    shown = F.format_string("%.2f", n.try_cast("double"))
    return F.when(n != "", F.regexp_replace(shown, r"\.?0+$", "")).otherwise(F.lit(None))


def whole_percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.concat(F.bround(part * 100 / total).cast("bigint").cast("string"), F.lit("%"))).otherwise("0%")
