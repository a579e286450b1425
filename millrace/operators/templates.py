"""Chat templates read from what they render: slots by alignment of renderings that hold marks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Render = Callable[[list[dict[str, str]]], str]
#: Contents that no template holds, of letters and digits only, so that trimming and escaping leave them as they are.
_MARKS = {role: tuple(f"Qz{role}{i}Kx" for i in range(3)) for role in ("system", "user", "assistant")}


@dataclass(frozen=True)
class Slots:
    """What stands before and after each role's content; ``prefix`` opens a text; ``last``: what ends it after an assistant; ``nested``: a system message stands inside the first user's."""

    prefix: str
    system: tuple[str, str]
    user: tuple[str, str]
    assistant: tuple[str, str]
    last: str
    nested: bool = False

    def render(self, messages: list[dict[str, str]]) -> str:
        out, waiting = [self.prefix], ""
        for i, m in enumerate(messages):
            before, after = getattr(self, m["role"])
            if m["role"] == "system" and self.nested:
                waiting = before + m["content"] + after
                continue
            if m["role"] == "assistant" and i == len(messages) - 1:
                after = self.last
            out.append(before + waiting + m["content"] + after)
            waiting = ""
        return "".join(out)


def _messages(*roles: str) -> list[dict[str, str]]:
    seen: dict[str, int] = {}
    out = []
    for role in roles:
        out.append({"role": role, "content": _MARKS[role][seen.get(role, 0)]})
        seen[role] = seen.get(role, 0) + 1
    return out


def _gaps(text: str, messages: list[dict[str, str]]) -> list[str]:
    """The text before, between and after the marks; each must stand once, in order."""
    out, at = [], 0
    for m in messages:
        i = text.find(m["content"], at)
        if i < 0 or text.count(m["content"]) != 1:
            raise ValueError(f"the template does not show each {m['role']} message once, in order")
        out.append(text[at:i])
        at = i + len(m["content"])
    return [*out, text[at:]]


def _common_end(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return a[len(a) - n :]


def infer_slots(render: Render) -> Slots:
    """TRN15: the slots of a template, from five renderings of marked messages.

    Where an assistant's part begins is what a rendering that ends with a user's
    message leaves open: all that follows the content there belongs to the user.
    A template that slots can't reproduce, such as one that counts its turns,
    raises ValueError.
    """
    dialogue = _messages("user", "assistant", "user", "assistant")
    head, turn, back, _, last = _gaps(render(dialogue), dialogue)
    if back.startswith(last) and head.endswith(back[len(last) :]):
        close, begin = last, back[len(last) :]
    else:
        begin = _common_end(head, back)
        close = back[: len(back) - len(begin)]
    prefix = head[: len(head) - len(begin)]
    asked = _messages("user")
    end = _gaps(render(asked), asked)[1]
    if not turn.startswith(end):
        raise ValueError("the template ends a user's message in more than one way")
    with_system = _messages("system", "user", "assistant")
    try:
        before, after, _, _ = _gaps(render(with_system), with_system)
    except ValueError:
        before, after = None, None  # no place for a system message
    nested, system = False, ("", "")
    if before is not None:
        if after.endswith(begin) and before.startswith(prefix):
            system = before[len(prefix) :], after[: len(after) - len(begin)]
        elif before.startswith(prefix + begin):
            nested, system = True, (before[len(prefix + begin) :], after)
        else:
            raise ValueError("the template changes its opening with a system message")
    found = Slots(prefix, system, (begin, end), (turn[len(end) :], close), last, nested)
    for roles in (("user",), ("user", "assistant"), ("user", "assistant", "user"), ("user", "assistant") * 3, *(((("system", "user"), ("system", "user", "assistant", "user", "assistant"))) if before is not None else ())):
        told = [m | {"content": m["content"] + " x1"} for m in _messages(*roles)]
        if found.render(told) != render(told):
            raise ValueError(f"slots do not reproduce the template for {', '.join(roles)}")
    return found


def jinja_render(template: str, generation: bool = False, **names: str) -> Render:
    """A renderer of a tokenizer's template text; ``names`` are its special tokens. Needs jinja2."""
    from jinja2.sandbox import ImmutableSandboxedEnvironment

    env = ImmutableSandboxedEnvironment(trim_blocks=True, lstrip_blocks=True)

    def fail(message: str) -> None:
        raise ValueError(message)

    env.globals["raise_exception"] = fail
    compiled = env.from_string(template)
    return lambda messages: compiled.render(messages=messages, add_generation_prompt=generation and messages[-1]["role"] == "user", **names)


def tokenizer_slots(config: str) -> Slots:
    """The slots of a tokenizer's configuration (JSON text) with its chat_template and special tokens."""
    found = json.loads(config)
    token = lambda v: v["content"] if isinstance(v, dict) else v or ""
    return infer_slots(jinja_render(found["chat_template"], True, **{k: token(v) for k, v in found.items() if k.endswith("_token")}))


def rendered(messages: Column, slots: Slots) -> Column:
    """The text of messages (role, content) with a template's slots; any other role counts as user."""
    n = F.size(messages)
    role = lambda i: F.element_at(messages, i).role
    content = lambda i: F.coalesce(F.element_at(messages, i).content, F.lit(""))

    def one(i: Column) -> Column:
        wrap = lambda s, c, end=None: F.concat(F.lit(s[0]), c, F.lit(s[1]) if end is None else end)
        system = wrap(slots.system, content(i))
        user = wrap(slots.user, content(i))
        if slots.nested:
            held = F.when((i > 1) & (role(F.greatest(i - 1, F.lit(1))) == "system"), wrap(slots.system, content(F.greatest(i - 1, F.lit(1))))).otherwise(F.lit(""))
            system, user = F.lit(""), wrap(slots.user, F.concat(held, content(i)))
        end = F.when(i == n, F.lit(slots.last)).otherwise(F.lit(slots.assistant[1]))
        return F.when(role(i) == "system", system).when(role(i) == "assistant", wrap(slots.assistant, content(i), end)).otherwise(user)

    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise(F.lit(""))
    return F.concat(F.lit(slots.prefix), body)
