"""Words of texts without blanks: the most probable path through the graph of known words."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a dictionary holds at most: those of the greatest counts.
MOST_WORDS = 200_000
#: Runs of letters and digits of scripts that write blanks, of characters of those that don't, and single other characters.
_UNSPACED = "ぁ-ヿ㐀-䶿一-鿿가-힣豈-﫿"
_BLOCKS = re.compile(rf"[{_UNSPACED}]+|[^\W_{_UNSPACED}]+|\S|\s+")


def count_words(df: DataFrame, words_col: str, most: int = MOST_WORDS) -> dict[str, int]:
    """Words and their counts over rows with lists of words; ties by word. At most ``most`` rows reach the driver."""
    words = df.select(F.explode(words_col).alias("w")).where("w is not null and trim(w) <> ''")
    return {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()}


class Segmenter:
    """A dictionary with counts, and every beginning of its words."""

    def __init__(self, counts: dict[str, int], everywhere: bool = False):
        self.counts, self.everywhere = counts, everywhere
        self.total = math.log(max(1, sum(counts.values())))
        self.logs = {w: math.log(n) - self.total for w, n in counts.items() if n}
        self.begins = {w[:i] for w in counts for i in range(1, len(w))}

    def path(self, text: str) -> list[str]:
        """The words of greatest joint probability; an unknown character counts once. Of equal paths, the one whose first word is longest."""
        n = len(text)
        best, step = [0.0] * (n + 1), [0] * n
        logs, begins, lone = self.logs, self.begins, -self.total
        for i in range(n - 1, -1, -1):
            word = text[i]
            at, to = logs.get(word, lone) + best[i + 1], i + 1
            j = i + 2
            while j <= n and word in begins:
                word = text[i:j]
                if (log := logs.get(word)) is not None and (value := log + best[j]) >= at:
                    at, to = value, j
                j += 1
            best[i], step[i] = at, to
        out, i = [], 0
        while i < n:
            out.append(text[i : step[i]])
            i = step[i]
        return out

    def __call__(self, text: str) -> list[str]:
        """Words of a text: paths inside runs without blanks (with ``everywhere``, inside runs of letters too), other runs and characters as they are."""
        out = []
        for block in _BLOCKS.findall(text):
            graph = block[0].isalnum() if self.everywhere else re.match(f"[{_UNSPACED}]", block)
            out += self.path(block) if graph else [block]
        return out
