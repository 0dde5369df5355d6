"""Preparation steps by name, composed from text (§2.12 of the coverage list).

A step is a ``DataFrame -> DataFrame`` function with options.  A chain is a JSON
list of ``{"step": name, option: value, …}``; it is checked as a whole before it
runs (names, options, their types) and, before each step, the columns that the
step needs.  Wrappers stand around every step of a chain: the first one given is
the outermost, its ``before`` runs first and its ``after`` last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.tokenizer import DEFAULT_TOKENIZER
from tidepool.operators import batching as bt, chat, normalise as nz, tokens as tk

_NONE = object()


class StepError(ValueError):
    """A chain that cannot be followed."""


@dataclass(frozen=True)
class Option:
    """The type of an option, and its default (required without)."""

    kind: type
    default: object = _NONE


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., DataFrame]
    options: dict[str, Option] = field(default_factory=dict)
    needs: tuple[str, ...] = ()     # columns; "@x": the column that option x names

    def bound(self, given: dict) -> dict:
        """The options with defaults; what does not fit raises."""
        for name in given.keys() - self.options.keys():
            raise StepError(f"step {self.name!r} has no option {name!r}; it has {sorted(self.options)}")
        out = {}
        for name, option in self.options.items():
            value = given.get(name, option.default)
            if value is _NONE:
                raise StepError(f"step {self.name!r} needs option {name!r}")
            fits = value is None and option.default is None or isinstance(value, option.kind) and (option.kind is bool or not isinstance(value, bool))
            if not fits:
                raise StepError(f"option {name!r} of step {self.name!r} is a {option.kind.__name__}, not {value!r}")
            out[name] = value
        return out

    def columns(self, options: dict) -> list[str]:
        return [options[c[1:]] if c.startswith("@") else c for c in self.needs]


class Wrapper:
    """What stands around a step; both hooks pass rows through by default."""

    def before(self, step: str, df: DataFrame) -> DataFrame:
        return df

    def after(self, step: str, df: DataFrame) -> DataFrame:
        return df


class DropColumns(Wrapper):
    """Takes columns away after each step, where they are."""

    def __init__(self, *names: str):
        self.names = names

    def after(self, step: str, df: DataFrame) -> DataFrame:
        return df.drop(*self.names)


class Registry(dict):
    """Steps by name."""

    def add(self, name: str, run: Callable[..., DataFrame], needs: Sequence[str] = (), **options: Option) -> None:
        if name in self:
            raise StepError(f"a step is called {name!r} already")
        self[name] = Step(name, run, options, tuple(needs))

    def chain(self, text: str | list, wrappers: Sequence[Wrapper] = ()) -> Callable[[DataFrame], DataFrame]:
        """The function that runs the steps of ``text`` one after another."""
        try:
            entries = json.loads(text) if isinstance(text, str) else list(text)
        except json.JSONDecodeError as e:
            raise StepError(f"a chain is a JSON list of steps: {e}") from None
        if not isinstance(entries, list) or not all(isinstance(e, dict) and isinstance(e.get("step"), str) for e in entries):
            raise StepError("a chain is a list of objects that name a step")
        plan = []
        for e in entries:
            if e["step"] not in self:
                raise StepError(f"no step is called {e['step']!r}; there are {sorted(self)}")
            step = self[e["step"]]
            plan.append((step, step.bound({k: v for k, v in e.items() if k != "step"})))

        def run(df: DataFrame) -> DataFrame:
            for step, options in plan:
                for w in wrappers:
                    df = w.before(step.name, df)
                missing = [c for c in step.columns(options) if c is not None and c not in df.columns]
                if missing:
                    raise StepError(f"step {step.name!r} needs column {missing[0]!r}; there are {df.columns}")
                df = step.run(df, **options)
                for w in reversed(wrappers):
                    df = w.after(step.name, df)
            return df

        return run


def standard(tokenizer=DEFAULT_TOKENIZER) -> Registry:
    """The steps of a preparation job, with a tokenizer."""
    r = Registry()
    r.add("instruction_messages", lambda df, **o: nz.norm_instruction(df, keep=tuple(c for c in df.columns if c not in o.values()), **o), ("@instruction",),
          instruction=Option(str, "instruction"), input=Option(str, "input"), output=Option(str, "output"))
    r.add("keep_language", lambda df, lang, column: nz.lang_equals(df, lang, lang_col=column), ("@column",), lang=Option(str), column=Option(str, "lang"))
    r.add("render", lambda df, template, messages: df.withColumn("text", chat.render(F.col(messages), template, False)), ("@messages",),
          template=Option(str, "chatml"), messages=Option(str, "messages"))
    r.add("encode_chat", lambda df, template, mask_prompt_loss, messages: chat.encode_sft(df, tokenizer, template, mask_prompt_loss, messages), ("@messages",),
          template=Option(str, "chatml"), mask_prompt_loss=Option(bool, True), messages=Option(str, "messages"))
    r.add("encode_text", lambda df, text: tk.encode_text(df, text, tokenizer), ("@text",), text=Option(str, "text"))
    r.add("append_eos", lambda df, eos_id: tk.append_eos(df, tokenizer.eos_token_id if eos_id is None else eos_id), ("input_ids",), eos_id=Option(int, None))
    r.add("filter_length", lambda df, max_length: tk.filter_length(df, max_length), ("input_ids",), max_length=Option(int))
    r.add("truncate", lambda df, max_length, truncation: tk.post_process(df, max_length, truncation), ("input_ids",), max_length=Option(int), truncation=Option(str, "filter"))
    r.add("align_block", lambda df, block_size: bt.align_block(df, block_size, tokenizer.eos_token_id), ("input_ids", "labels"), block_size=Option(int))
    r.add("keep_columns", lambda df, names: df.select(*names), (), names=Option(list))
    return r
