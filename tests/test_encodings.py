import random

import pytest
from pyspark.sql import functions as F

from millrace.sources.encodings import EncodingModel, class_pairs, detected, read_detected, valid

#: Texts that no sample sentence of the module repeats.
TEXTS = {
    "gbk": "春天来了，公园里的花都开了，孩子们在草地上跑来跑去，老人坐在长椅上晒太阳。他说这条河以前很干净，可以游泳，后来工厂多了，水就变黑了。现在政府花了很多钱治理，鱼又回来了。她每天早上六点起床，先做早饭，然后送女儿去学校，再坐地铁上班。这本书一共有三百二十页，讲的是一个年轻人离开家乡去大城市工作的故事。电脑坏了怎么办？先别着急，把电源关掉，等一分钟再打开，如果还是不行，就打电话给客服。",
    "big5": "春天來了，公園裡的花都開了，孩子們在草地上跑來跑去，老人坐在長椅上曬太陽。他說這條河以前很乾淨，可以游泳，後來工廠多了，水就變黑了。現在政府花了很多錢治理，魚又回來了。她每天早上六點起床，先做早飯，然後送女兒去學校，再坐捷運上班。這本書一共有三百二十頁，講的是一個年輕人離開家鄉去大城市工作的故事。電腦壞了怎麼辦？先別著急，把電源關掉，等一分鐘再打開，如果還是不行，就打電話給客服。",
    "shift_jis": "春になると公園の花がいっせいに咲き、子どもたちは芝生の上を走り回ります。祖父はベンチに座って、昔この川で泳いだことを話してくれました。工場が増えてから水が汚れてしまいましたが、最近はまた魚が戻ってきたそうです。彼女は毎朝六時に起きて朝ごはんを作り、娘を学校へ送ってから電車で会社に行きます。この本は若者が故郷を離れて大きな町で働く物語です。パソコンが動かないときは、電源を切って一分待ってください。",
    "euc_kr": "봄이 되면 공원의 꽃이 한꺼번에 피고 아이들은 잔디밭을 뛰어다닙니다. 할아버지는 의자에 앉아 옛날에 이 강에서 헤엄치던 이야기를 해 주셨습니다. 공장이 늘어난 뒤로 물이 더러워졌지만 요즘은 물고기가 다시 돌아왔다고 합니다. 그녀는 매일 아침 여섯 시에 일어나 밥을 짓고 딸을 학교에 데려다준 다음 전철을 타고 회사에 갑니다. 이 책은 젊은이가 고향을 떠나 큰 도시에서 일하는 이야기입니다.",
    "cp1251": "Весной в парке расцветают цветы, дети бегают по траве, а старики сидят на скамейках и греются на солнце. Раньше в этой реке купались, потом построили завод, и вода стала чёрной. Теперь рыба вернулась. Каждое утро она встаёт в шесть, готовит завтрак, отводит дочь в школу и едет на метро на работу. В книге триста двадцать страниц; она рассказывает о юноше, который уехал из родного города. Если компьютер сломался, не спешите: выключите его и подождите минуту.",
    "cp1252": "Au printemps, les fleurs du parc s'ouvrent toutes à la fois et les élèves courent sur l'herbe. Mon grand-père, assis près de la fenêtre, répétait que l'eau était très propre à l'époque. Im Frühling blühen die Bäume, und die Kinder spielen draußen, während die Älteren auf der Bank sitzen und über früher reden. Jeden Morgen fährt sie mit der Straßenbahn zur Universität. En otoño mi tía preparaba café y nos contaba cómo era el pueblo cuando era niña; después salíamos a pasear por la montaña.",
}
TEXTS |= {"euc_jp": TEXTS["shift_jis"], "koi8_r": TEXTS["cp1251"]}


def pieces(n, size, seed=1):
    """Labelled pieces of ``size`` bytes: the first may be cut inside its last character only."""
    rnd = random.Random(seed)
    for _ in range(n):
        encoding = rnd.choice(sorted(TEXTS))
        text = TEXTS[encoding]
        raw = text[rnd.randrange(max(1, len(text) - size)) :].encode(encoding)[:size]
        if len(raw) >= size * 0.9 and any(b >= 0x80 for b in raw):
            yield encoding, raw


@pytest.mark.parametrize(("size", "least"), [(200, 0.95), (60, 0.9)])
def test_eight_encodings_are_told_apart(size, least):
    model = EncodingModel.default()
    got = [(want, model.detect(raw)[0]) for want, raw in pieces(600, size)]
    assert len(got) > 300 and len({w for w, _ in got}) == 8
    for encoding in TEXTS:
        own = [g for w, g in got if w == encoding]
        assert sum(g == encoding for g in own) / len(own) >= least - 0.05, (encoding, own)
    assert sum(w == g for w, g in got) / len(got) >= least


def test_marks_unicode_and_bytes_that_nothing_takes():
    model = EncodingModel.default()
    text = "Grüße aus Köln, 汉字"
    for encoding, mark in (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\x00\x00")):
        assert model.detect(mark + text.encode(encoding)) == (encoding, 1.0)
    assert model.detect(b"") == ("utf-8", 1.0) and model.detect(text.encode())[0] == "utf-8" and model.detect(text.encode()[:-1])[0] == "utf-8"
    for encoding in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert model.detect("A plain sentence of words.".encode(encoding))[0] == encoding
    few = EncodingModel({"gbk": class_pairs("汉字", "gbk")})
    assert few.detect(b"\xff\x81\x20\x8d\xff\x80") == ("latin1", 0.0) and few.detect(b"\xff\x80")[0] == "cp1252" and valid(b"\xff", "utf-8") is None


def test_as_a_column_and_over_files(spark, tmp_path):
    rows = [(k, t[:150].encode(k)) for k, t in TEXTS.items()] + [("utf-8", "ascii and é".encode()), (None, None), ("utf-16-le", "﻿plain words".encode("utf-16-le"))]
    got = spark.createDataFrame(rows, "want string, raw binary").select("want", detected(F.col("raw")).alias("d")).collect()
    for r in got:
        assert (r.d is None) if r.want is None else (r.d.encoding == r.want and not r.d.text.startswith("﻿") and "�" not in r.d.text)
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode(name))
    files = {r.path.rsplit("/", 1)[-1][:-4]: (r.encoding, r.text) for r in read_detected(spark, str(tmp_path)).collect()}
    assert files == {k: (k, t) for k, t in TEXTS.items()}
    labelled = spark.createDataFrame([(k, t) for k, t in TEXTS.items()] * 2 + [("gbk", None), ("none", "x")], "encoding string, text string")
    model = EncodingModel.train(labelled)
    assert sorted(model.logs) == sorted(TEXTS) and sum(model.detect(raw)[0] == want for want, raw in pieces(100, 200)) >= 0.95 * len(list(pieces(100, 200)))


def test_ascii_around_a_few_letters_is_no_evidence(spark):
    model = EncodingModel.default()
    lone = '4734663219866878$$$ token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"### La%%% échment hmentré.### 1'
    assert model.detect(lone.encode("latin1"))[0] == "cp1252"
    around = '### $$$ 1234567 %%% "40d78a", 2.0 [x] '.encode() * 3
    for encoding in ("gbk", "big5", "shift_jis", "koi8_r"):
        raw = TEXTS[encoding][:60].encode(encoding)
        assert model.detect(raw)[0] == encoding and model.detect(around + raw + around)[0] == encoding
    row = spark.createDataFrame([(lone.encode("latin1"),)], "raw binary").select(detected(F.col("raw")).alias("d")).first()
    assert row.d.text == lone and row.d.encoding == "cp1252"
