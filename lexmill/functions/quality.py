"""Rule-based quality, adult-content and toxicity verdicts, in two variants each.

`pkg` is the looser variant, `strict` the one with more rules; they disagree on
purpose and are both kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SOLID, WHITE, WHITE_CHARS, count_of, fewer_words, let, strip, words

#: Keywords that are looked for anywhere in the lower-cased text.
NSFW_PKG = ["porn", "xxx", "adult", "explicit", "nude"]
NSFW_STRICT = ["porn", "xxx", "nude", "explicit", "obscene", "cock", "cunt", "ass", "fuck", "shit", "bitch", "c*ck", "c*nt", "f*ck", "a**", "*ssh*le"]
TOXIC_PKG = ["hate", "kill", "die", "stupid", "idiot"]
TOXIC_STRICT = ["idiot", "moron", "rude fuck", "arrogant", "fuckers", "fuck", "twat", "asshole"]
#: Boilerplate patterns, each of which is one signal.
BOILERPLATE = [r"\bFAQ\b", r"\bSearch\b", r"\bRegister\b", r"\bLog in\b", r"\bMemberlist\b", r"\bUsergroups\b", r"\bProfile\b", "Copyright ©", "Powered by"]
#: Limits of the quality rules.
LEAST_WORDS, MOST_WORDS, LEAST_MEAN, MOST_MEAN = 50, 100_000, 3, 10
MOST_SYMBOLS, MOST_BULLETS, MOST_ELLIPSES = 0.1, 0.9, 0.3
LEAST_ALPHABETIC, MOST_ELLIPSIS_LINES = 0.8, 0.3
SHORT_LINE = rf"^{WHITE}*+{SOLID}++(?:{WHITE}++{SOLID}++){{0,2}}{WHITE}*+\z"  # one to three words


def _any(text: Column, keys: list[str]) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in keys)))


def _hits(text: Column, keys: list[str]) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a + b, (F.contains(low, F.lit(k)).cast("int") for k in keys)))


def nsfw_pkg(text: Column) -> Column:
    return _any(text, NSFW_PKG)


def nsfw_strict(text: Column) -> Column:
    return F.struct(F.when(_any(text, NSFW_STRICT), "nsfw").otherwise("non-nsfw").alias("label"), F.lit(1.0).alias("score"))


def toxic_pkg(text: Column) -> Column:
    return _any(text, TOXIC_PKG)


def toxic_strict(text: Column) -> Column:
    return let(_hits(text, TOXIC_STRICT), lambda hits: F.struct(F.when(hits >= 2, "toxic").otherwise("non-toxic").alias("label"), F.when(hits >= 2, hits.cast("double")).otherwise(1.0).alias("score")))


def quality_class(text: Column) -> Column:
    few = lambda t: fewer_words(t, 100)
    # a search for the bare words comes before each pattern; the long s counts as an s when case does not
    hit = lambda t, low, p: (F.contains(low, F.lit(p.replace(r"\b", "").lower())) & t.rlike(f"(?iu){p}")).cast("int")
    boilerplate = lambda t: let(F.lower(F.replace(t, F.lit("ſ"), F.lit("s"))), lambda low: reduce(lambda a, b: a + b, (hit(t, low, p) for p in BOILERPLATE)))
    # a menu has mostly lines of one to three words; of six lines or fewer none is looked at
    short = lambda lines: F.size(F.filter(lines, lambda line: line.rlike(SHORT_LINE)))
    menu = lambda t: let(F.split(strip(t), "\n", -1), lambda lines: F.when(F.size(lines) > 5, short(lines) / F.size(lines) > 0.5).otherwise(False))
    signals = let(text, lambda t: 2 * few(t).cast("int") + boilerplate(t) + 2 * menu(t).cast("int"))
    return let(signals, lambda s: F.struct(F.when(s >= 3, "cc").otherwise("wiki").alias("label"), F.when(s >= 3, s.cast("double")).otherwise(1.0 / F.greatest(F.lit(1), s + 1)).alias("score")))


def _common(ws: Column) -> Column:
    n = F.size(ws)
    mean = F.try_divide(F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w)), n)
    return n.between(LEAST_WORDS, MOST_WORDS) & mean.between(LEAST_MEAN, MOST_MEAN)


def gopher_pkg(text: Column) -> Column:
    def kept(t: Column, ws: Column) -> Column:
        share = lambda count: F.coalesce(F.try_divide(count, F.size(ws)), F.lit(0.0))
        symbols = F.length(t) - F.length(F.translate(t, "#$%&*@", ""))
        bullets = F.length(t) - F.length(F.translate(t, "•-*", ""))
        return _common(ws) & (share(symbols) <= MOST_SYMBOLS) & (share(bullets) <= MOST_BULLETS) & (share(count_of(t, "...")) <= MOST_ELLIPSES)

    return F.coalesce(let(text, lambda t: let(words(t), lambda ws: kept(t, ws))), F.lit(False))


def gopher_strict(text: Column) -> Column:
    def kept(ws: Column, lines: Column) -> Column:
        alphabetic = F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}")))
        trailing = F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(WHITE_CHARS)).endswith("...")))
        return _common(ws) & (F.try_divide(alphabetic, F.size(ws)) >= LEAST_ALPHABETIC) & (trailing / F.size(lines) <= MOST_ELLIPSIS_LINES)

    return F.coalesce(let(text, lambda t: let(words(t), lambda ws: let(F.split(t, "\n", -1), lambda lines: kept(ws, lines)))), F.lit(False))


def reject_reason(text: Column) -> Column:
    """The first filter that rejects a text; null if none does."""
    return let(text, lambda t: F.when(nsfw_pkg(t), "nsfw").when(toxic_pkg(t), "toxicity").when(~gopher_pkg(t), "gopher"))
