"""Which encoding bytes are in: validity of every candidate, then the likelihood of what it decodes to.

A candidate's decoder is an automaton over bytes; one that rejects the bytes is
out. The others are compared by the likelihood of the classes of neighbouring
characters: a character's class is its script, its case, and for characters of
two bytes whether the standard's table has them among the frequent ones, which
the tables of China, Taiwan, Japan and Korea list first. Class pairs are counted
over sample sentences of each language; ``EncodingModel.train`` counts them over
texts of the caller's own.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks and the encodings that they stand for.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Candidates that are told apart by likelihood, with the first and last lead byte of their frequent characters.
CANDIDATES = {"gbk": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "shift_jis": (0x88, 0x97), "euc_jp": (0xB0, 0xCF), "euc_kr": (0xB0, 0xC8), "cp1251": None, "koi8_r": None, "cp1252": None}
#: Sentences of each candidate's language, to count class pairs in.
SAMPLES = {
    "gbk": "今天的会议讨论了三个问题：第一，产品什么时候可以上线；第二，数据从哪里来；第三，谁来负责维护。大家认为时间比较紧，但是只要安排合理，月底之前应该能够完成。请把修改后的文件发给我，谢谢！系统版本为2.0，共有128个用户。我们希望在下个月开始新的训练，并且把结果写进报告里面。",
    "big5": "今天的會議討論了三個問題：第一，產品什麼時候可以上線；第二，資料從哪裡來；第三，誰來負責維護。大家認為時間比較緊，但是只要安排合理，月底之前應該能夠完成。請把修改後的檔案寄給我，謝謝！系統版本為2.0，共有128個使用者。我們希望在下個月開始新的訓練，並且把結果寫進報告裡面。",
    "shift_jis": "今日の会議では三つの問題について話しました。まず、製品をいつ公開できるか。次に、データをどこから集めるのか。最後に、だれが保守を担当するのかということです。時間はあまりありませんが、予定どおりに進めば月末までに終わると思います。修正したファイルを送ってください。よろしくお願いします。バージョンは2.0です。",
    "euc_kr": "오늘 회의에서는 세 가지 문제를 이야기했습니다. 첫째, 제품을 언제 공개할 수 있는지. 둘째, 자료를 어디에서 가져오는지. 셋째, 누가 관리를 맡을 것인지입니다. 시간이 많지 않지만 계획대로 진행하면 월말까지 끝낼 수 있을 것 같습니다. 수정한 파일을 보내 주세요. 감사합니다! 버전은 2.0입니다.",
    "cp1251": "На сегодняшней встрече мы обсудили три вопроса: когда можно выпустить продукт, откуда взять данные и кто будет отвечать за поддержку. Времени мало, но если всё правильно спланировать, к концу месяца успеем. Пришлите, пожалуйста, исправленный файл. Спасибо! Версия 2.0, всего 128 пользователей. Москва и Россия. ВНИМАНИЕ: НЕ ВХОДИТЬ!",
    "cp1252": "La réunion d'aujourd'hui a porté sur trois questions : quand le produit sera-t-il prêt, d'où viennent les données, et qui s'en occupera après l'été. Das Gerät läuft über Nacht, und die Größe der Dateien ändert sich täglich; schöne Grüße aus Köln. El año pasado la compañía abrió una oficina en España, ¿por qué no? Às vezes é difícil, não é? Merci à tous, à bientôt. The new version is 2.0 and there are 128 users. ATTENTION À LA MARCHE! ÉTÉ 2024. DIE GRÖSSE ÄNDERN; FÜR ÜBUNG. INFORMACIÓN EN ESPAÑOL, AÑO ÚLTIMO. FRANÇAIS.",
}
SAMPLES |= {"euc_jp": SAMPLES["shift_jis"], "koi8_r": SAMPLES["cp1251"]}
_CLASSES = 16
(_SPACE, _DIGIT, _ASCII_UP, _ASCII_LOW, _PUNCT, _CONTROL, _FREQUENT, _RARE, _HIRAGANA, _KATAKANA, _WIDE_PUNCT, _SYMBOL, _HIGH_LOW, _HIGH_UP, _HALF, _NONE) = range(_CLASSES)
#: The first classes are those of ASCII, some of them letters.
_ASCII = _CONTROL + 1
_LETTERS = np.isin(np.arange(_ASCII), (_ASCII_UP, _ASCII_LOW))[:, None]

#: Classes whose letters do not meet inside a word, except where a sample shows that they do.
_MIXED = [(a, b) for a in (_ASCII_UP, _ASCII_LOW) for b in (_HIGH_LOW, _HIGH_UP, _HALF)]


@lru_cache(maxsize=16)
def classes(encoding: str) -> np.ndarray:
    """The class of each character of the basic plane, as the encoding's table orders them."""
    out = np.full(1 << 16, _NONE, np.uint8)
    span = CANDIDATES.get(encoding)
    for code in range(1 << 16):
        c = chr(code)
        if code < 0x80:
            out[code] = _SPACE if c in " \t\n\r" else _CONTROL if code < 0x20 or code == 0x7F else _DIGIT if c.isdigit() else _ASCII_UP if c.isupper() else _ASCII_LOW if c.islower() else _PUNCT
            continue
        if 0x3041 <= code <= 0x309F:
            out[code] = _HIRAGANA
        elif 0x30A0 <= code <= 0x30FF:
            out[code] = _KATAKANA
        elif 0xFF61 <= code <= 0xFF9F:
            out[code] = _HALF
        elif 0x3000 <= code <= 0x303F or 0xFF00 <= code <= 0xFF60 or c in "“”‘’…—·":
            out[code] = _WIDE_PUNCT
        elif 0x80 <= code < 0xA0:
            out[code] = _CONTROL
        elif span and (0x4E00 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3):
            raw = c.encode(encoding, "ignore")
            trail = 0x40 if encoding in ("big5", "shift_jis") else 0xA1
            out[code] = _FREQUENT if len(raw) == 2 and span[0] <= raw[0] <= span[1] and raw[1] >= trail else _RARE
        elif c.islower():
            out[code] = _HIGH_LOW
        elif c.isupper():
            out[code] = _HIGH_UP
        else:
            out[code] = _SYMBOL
    return out


def class_pairs(text: str, encoding: str) -> np.ndarray:
    """Counts of neighbouring classes, as a vector."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.where(codes < 1 << 16, classes(encoding)[np.minimum(codes, 0xFFFF)], _NONE).astype(np.int64)
    found = np.concatenate(([_SPACE], found))
    return np.bincount(found[:-1] * _CLASSES + found[1:], minlength=_CLASSES**2)


class EncodingModel:
    """Log likelihoods of class pairs by encoding."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.05):
        less = np.full((_CLASSES, _CLASSES), smooth)
        for pair in _MIXED:  # a word of two scripts is no accident of a small sample
            less[pair] = less[pair[::-1]] = smooth / 100
        table = {k: v.reshape(_CLASSES, _CLASSES) + less for k, v in counts.items()}
        # all candidates read ASCII alike: how it goes on is no evidence, only whether a letter leaves it
        share = {k: t / t.sum(axis=1, keepdims=True) for k, t in table.items()}
        pool = sum(share.values()) / len(share)
        inside = pool[:_ASCII, :_ASCII].sum(axis=1, keepdims=True)
        for p in share.values():
            own = p[:_ASCII, :_ASCII].sum(axis=1, keepdims=True)
            stays = np.where(_LETTERS, own, inside)
            p[:_ASCII, _ASCII:] *= (1 - stays) / (1 - own)
            p[:_ASCII, :_ASCII] = stays * pool[:_ASCII, :_ASCII] / inside
        self.logs = {k: np.log(p).ravel() for k, p in share.items()}

    @classmethod
    def default(cls) -> EncodingModel:
        return cls({k: class_pairs(text, k) for k, text in SAMPLES.items()})

    @classmethod
    def train(cls, texts: DataFrame, text_col: str = "text", encoding_col: str = "encoding") -> EncodingModel:
        """Counted over texts with the name of the encoding whose language they are in; at most classes squared rows an encoding reach the driver."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for text, encoding in zip(batch[text_col], batch[encoding_col], strict=True):
                    total[encoding] = total.get(encoding, 0) + class_pairs(text, encoding)
            for encoding, found in total.items():
                at = np.flatnonzero(found)
                yield pd.DataFrame({"encoding": encoding, "pair": at, "n": found[at]})

        known = texts.where(F.col(text_col).isNotNull() & F.col(encoding_col).isin(*CANDIDATES)).select(text_col, encoding_col)
        rows = known.mapInPandas(run, "encoding string, pair long, n long").groupBy("encoding", "pair").agg(F.sum("n").alias("n")).collect()
        counts: dict[str, np.ndarray] = {}
        for r in rows:
            counts.setdefault(r.encoding, np.zeros(_CLASSES**2))[r.pair] = r.n
        return cls(counts)

    def detect(self, raw: bytes) -> tuple[str, float]:
        """The encoding, and how sure it is: 1 for marks, valid UTF-8 and a single valid candidate, else its share of likelihood per character."""
        for mark, encoding in MARKS:
            if raw.startswith(mark):
                return encoding, 1.0
        wide = _without_mark(raw)
        if wide:
            return wide, 1.0
        if valid(raw, "utf-8") is not None:
            return "utf-8", 1.0
        found = {}
        for encoding in self.logs:
            text = valid(raw, encoding)
            if text is not None:
                found[encoding] = float(class_pairs(text, encoding) @ self.logs[encoding])
        if not found:
            return "cp1252" if valid(raw, "cp1252") is not None else "latin1", 0.0
        best = max(found, key=lambda k: (found[k], k))
        return best, float(1 / sum(np.exp(np.clip((v - found[best]) / max(1, len(raw)) * 8, -50, 0)) for v in found.values()))


def valid(raw: bytes, encoding: str) -> str | None:
    """The text, if the encoding's decoder takes all bytes; a character that the end cuts off does not count."""
    try:
        return codecs.getincrementaldecoder(encoding)().decode(raw, final=False)
    except UnicodeDecodeError:
        return None


def _without_mark(raw: bytes) -> str | None:
    """UTF-16 and UTF-32 without a mark, by where the zero bytes are."""
    n = len(raw) // 4 * 4
    if n < 8:
        return None
    zero = (np.frombuffer(raw[:n], np.uint8).reshape(-1, 4) == 0).mean(axis=0)
    for encoding, blank, filled in (("utf-32-le", (2, 3), 0), ("utf-32-be", (0, 1), 3)):
        if all(zero[i] > 0.9 for i in blank) and zero[filled] < 0.1 and valid(raw, encoding) is not None:
            return encoding
    for encoding, blank, filled in (("utf-16-le", (1, 3), (0, 2)), ("utf-16-be", (0, 2), (1, 3))):
        if all(zero[i] > 0.3 for i in blank) and all(zero[i] < 0.1 for i in filled) and valid(raw, encoding) is not None:
            return encoding
    return None


def detected(raw: Column, model: EncodingModel | None = None) -> Column:
    """encoding, confidence and text of bytes; null stays null. Valid UTF-8 stays in the JVM.

    Bytes that none of the model's encodings takes are read as cp1252, or latin1, which takes all.
    """
    own = model or EncodingModel.default()

    @F.pandas_udf("encoding string, confidence double, text string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch:
                if b is None:
                    rows.append((None, None, None))
                    continue
                encoding, sure = own.detect(b)
                text = b.decode(encoding, "replace")
                rows.append((encoding, sure, text.removeprefix("﻿")))
            yield pd.DataFrame(rows, columns=["encoding", "confidence", "text"])

    text = raw.cast("string")
    plain = F.is_valid_utf8(text) & ~F.contains(raw, F.lit(b"\x00"))
    utf8 = F.struct(F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("confidence"), F.regexp_replace(text, "^﻿", "").alias("text"))
    return F.when(raw.isNotNull(), F.when(plain, utf8).otherwise(found(F.when(~plain, raw))))


def read_detected(spark: SparkSession, path: str, model: EncodingModel | None = None) -> DataFrame:
    """path, encoding, confidence, text of each file."""
    return spark.read.format("binaryFile").load(path).select("path", detected(F.col("content"), model).alias("d")).select("path", "d.*")
