"""Language detection for routing: function words and letters, counted in the JVM.

The score of a language is the share of a text's words that are among its commonest ones, and for scripts
of one language the share of its letters. The confidence is the winner's share of all scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

COMMON = {
    "en": "the of and to in is that it for was on as with be by this are at from or an have not which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un une du que est pour qui dans par au sur plus ne se pas avec",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o",
    "it": "di e il la che in un a per è una non del si con le i da al sono nel della come",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij",
    "sv": "och i att det som en på är av för med till den har inte om ett men de var så",
    "pl": "i w na z się do nie że jest to o jak po za od co dla przez ale tym być",
    "tr": "ve bir bu için da de ile çok olarak daha gibi en olan sonra kadar ama ne o",
    "ht": "yo nan ki ak pou li te se yon la a sa pa gen fè lè tou mwen ou",
}
SCRIPTS = {
    "ru": r"[а-яё]", "el": r"[α-ωά-ώ]", "he": r"[א-ת]", "ar": r"[ؠ-ي]", "hi": r"[ऄ-ह]",
    "bn": r"[অ-হ]", "ta": r"[அ-ஹ]", "te": r"[అ-హ]", "th": r"[ก-ะ]", "ko": r"[가-힣]",
    "ja": r"[ぁ-ヿ]", "zh": r"[一-鿿]", "ka": r"[ა-ჰ]", "hy": r"[ա-և]", "am": r"[ሀ-ፗ]",
}


def detect(text: Column) -> Column:
    """struct code, confidence; ('und', 0) for text that nothing is known of, null for null."""

    def scored(x: Column) -> Column:
        words, letters, far = x["words"], x["letters"], x["far"]
        common = lambda of: F.size(F.filter(words, lambda w: w.isin(*of.split()))).cast("double")
        scores = [F.struct(common(c).alias("s"), F.lit(k).alias("k")) for k, c in COMMON.items()]
        # letters of these scripts are far from Latin ones
        count = lambda p: F.when(far, F.regexp_count(letters, F.lit(p))).otherwise(0)
        return F.array(*scores, *[F.struct((count(p) / (20.0 if k == "zh" else 2.0)).cast("double").alias("s"), F.lit(k).alias("k")) for k, p in SCRIPTS.items()])

    def judged(every: Column) -> Column:
        best = F.array_max(every)
        total = F.aggregate(every, F.lit(0.0), lambda a, x: a + x["s"] * x["s"])
        return F.when(total == 0, F.struct(F.lit("und").alias("code"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(best["k"].alias("code"), (best["s"] * best["s"] / total).alias("confidence")))

    words = F.split(F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))), " ")
    given = F.struct(words.alias("words"), F.lower(text).alias("letters"), text.rlike(r"[^\x00-˿]").alias("far"))
    return F.when(text.isNotNull(), let(let(given, scored), judged))


def route(code: Column, confidence: Column | None = None, floor: float = 0.7) -> Column:
    """The language to split by: the detected one, or "fallback" where the confidence is below the floor."""
    return code if confidence is None else F.when(confidence >= floor, code).otherwise(F.lit("fallback"))
