import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.datasets import CHAT_TEMPLATES
from millrace.operators.templates import Slots, infer_slots, jinja_render, rendered, tokenizer_slots


def shipped(name):
    slots = CHAT_TEMPLATES[name]
    return lambda messages: "".join(slots[m["role"]][0] + m["content"] + slots[m["role"]][1] for m in messages)


@pytest.mark.parametrize("name", CHAT_TEMPLATES)
def test_shipped_templates_are_recovered_from_their_text(name):
    want, got = CHAT_TEMPLATES[name], infer_slots(shipped(name))
    assert (got.prefix, got.last, got.nested) == ("", want["assistant"][1], False)
    assert {r: getattr(got, r) for r in want} == want


CASES = [
    Slots("<s>", ("[SYS]", "[/SYS]"), ("[INST] ", " [/INST]"), (" ", " </s>"), " </s>"),
    Slots("<s>", ("<<SYS>>\n", "\n<</SYS>>\n\n"), ("[INST] ", " [/INST]"), (" ", " </s><s>"), " </s>", nested=True),
    Slots("", ("S:", "\n"), ("U:", "\n"), ("A:", "\n\n"), ""),
]
TALKS = [["user"], ["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["system", "user", "assistant", "user"]]


@pytest.mark.parametrize("slots", CASES)
def test_prefixes_last_turns_and_nested_system_messages(spark, slots):
    got = infer_slots(slots.render)
    talks = [[{"role": r, "content": f"text {i} é"} for i, r in enumerate(t)] for t in TALKS]
    assert all(got.render(t) == slots.render(t) for t in talks)
    df = spark.createDataFrame([(i, [(m["role"], m["content"]) for m in t]) for i, t in enumerate(talks)] + [(9, [])], "i int, m array<struct<role:string,content:string>>")
    out = {r.i: r.t for r in df.select("i", rendered(F.col("m"), got).alias("t")).collect()}
    assert out == {i: slots.render(t) for i, t in enumerate(talks)} | {9: got.prefix}


def test_templates_that_slots_cannot_reproduce():
    for render in (lambda ms: f"{len(ms)}:" + "".join(m["content"] for m in ms), lambda ms: "none", lambda ms: "".join(f"{i}{m['role']}{m['content']}." for i, m in enumerate(ms)), lambda ms: "".join(m["content"] * 2 for m in ms)):
        with pytest.raises(ValueError):
            infer_slots(render)


def test_a_tokenizer_configuration():
    pytest.importorskip("jinja2")
    text = "{{ bos_token }}{% for m in messages %}{{ '<|' + m['role'] + '|>\n' + m['content'] + eos_token + '\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|assistant|>\n' }}{% endif %}"
    slots = tokenizer_slots(json.dumps({"chat_template": text, "bos_token": "<s>", "eos_token": {"content": "</s>"}}))
    assert slots == Slots("<s>", ("<|system|>\n", "</s>\n"), ("<|user|>\n", "</s>\n<|assistant|>\n"), ("", "</s>\n"), "</s>\n")
    strict = "{% for m in messages %}{% if m['role'] == 'system' %}{{ raise_exception('no') }}{% endif %}{{ m['role'] + ': ' + m['content'] + '\n' }}{% endfor %}"
    assert infer_slots(jinja_render(strict)).user == ("user: ", "\n")
