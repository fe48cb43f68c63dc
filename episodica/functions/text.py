"""Text: chat templates, token examples with loss masks, chunks. The tokenizer is a function from a text column to a column of ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodica.functions import vectors as V

#: What the templates put around messages, and the label that a loss leaves out.
EOS, IGNORED = "</s>", -100
WHITE = r"[ \t\n\r\f\x0B]"

Tokenizer = Callable[[Column], Column]


def stripped(s: Column) -> Column:
    """Without white space at both ends, line ends too."""
    return F.regexp_replace(F.regexp_replace(s, rf"^{WHITE}+", ""), rf"{WHITE}+$", "")


def byte_ids(text: Column) -> Column:
    """The tokenizer by default: a text's UTF-8 bytes as ids."""
    letters = F.split(F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), "")  # a character for each byte
    return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.ascii(c))


def word_ids(buckets: int = 32_000) -> Tokenizer:
    """Words as ids by hash."""
    return lambda text: F.transform(F.filter(F.split(text, rf"{WHITE}+"), lambda w: w != ""), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % buckets).cast("int"))


def plain(role: Column, content: Column, eos: str = EOS) -> Column:
    """Role: content, ended by eos and a line end."""
    return F.concat(F.initcap(role), F.lit(": "), stripped(content), F.lit(f"{eos}\n"))


def instructed(role: Column, content: Column, eos: str = EOS, bos: str = "<s>") -> Column:
    """Instruction marks for system, user, assistant and tool messages; any other role raises."""
    c = stripped(content)
    known = {
        "system": F.concat(F.lit("<<SYS>>\n"), c, F.lit("\n<</SYS>>\n\n")),
        "user": F.concat(F.lit(f"{bos}[INST] "), c, F.lit(" [/INST]")),
        "assistant": F.concat(F.lit(" "), c, F.lit(f" {eos}")),
        "tool": F.concat(F.lit(f"{bos}[TOOL] "), c, F.lit(" [/TOOL]")),
    }
    out = F.when(F.lit(False), "")
    for r, text in known.items():
        out = out.when(role == r, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("string"))


def chatml(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), stripped(content), F.lit("<|im_end|>\n"))


#: The separators of two-party chats, and the request that a tutorial task adds to its system message.
SEPARATORS = ("\n\n", "<｜end▁of▁sentence｜>")
TUTORIAL = "Please generate a step-by-step tutorial with images for the following question."


def two_party(role: Column, content: Column, task: str = "", first_answer: Column | None = None, is_last: Column | None = None) -> Column:
    """Roles by what their names contain. User and system turns end with the first separator, answers with the second.

    An empty message is the role and a colon. In generation tasks only the first answer names the assistant, and only the last message ends
    with the second separator; first_answer and is_last tell which they are.
    """
    c, tutorial = stripped(content), "wikihow_generation" in task
    answer = F.concat(F.lit("Assistant: "), c, F.lit(SEPARATORS[1]))
    if tutorial or "interleave_generation" in task:
        answer = F.concat(F.when(first_answer, F.lit("Assistant: ")).otherwise(F.lit("")), c, F.when(is_last, F.lit(SEPARATORS[1])).otherwise(F.lit(SEPARATORS[0])))
    system = F.concat(c, F.lit(SEPARATORS[0] + (TUTORIAL + SEPARATORS[0] if tutorial else "")))
    out = F.when(content == "", F.concat(role, F.lit(":"))).when(role.contains("assistant"), answer).when(role.contains("user"), F.concat(F.lit("User: "), c, F.lit(SEPARATORS[0])))
    return out.when(role.contains("system"), system)


TEMPLATES: dict[str, Callable[[Column, Column], Column]] = {"default": plain, "llama2": instructed, "chatml": chatml, "Janus": two_party}


def template(name: str) -> Callable[[Column, Column], Column]:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name}")
    return TEMPLATES[name]


def framed(prompt: Column, bos: str = "<bos>") -> Column:
    """With bos before and a line end after, unless they are there."""
    s = F.when(prompt.startswith(bos), prompt).otherwise(F.concat(F.lit(bos), prompt))
    return F.when(s.endswith("\n"), s).otherwise(F.concat(s, F.lit("\n")))


def first_present(columns: Sequence[str], keys: Sequence[str]) -> Column:
    """The first of keys that is a column; raises if none is."""
    for k in keys:
        if k in columns:
            return F.col(k)
    raise ValueError(f"none of {list(keys)} is there")


def labels(ids: Column, loss_mask: Column) -> Column:
    """ids where the loss counts, else the ignored label."""
    return F.transform(ids, lambda i: F.when(loss_mask == 1, i).otherwise(F.lit(IGNORED)))


def tail(x: Column, size: int) -> Column:
    """The last size values."""
    return F.when(F.size(x) > size, F.slice(x, -size, size)).otherwise(x)


def pretrain_chunks(text: Column, tokenizer: Tokenizer, eos_id: int, size: int) -> Column:
    """Ids with eos at the end, in chunks."""
    return V.chunks(F.concat(tokenizer(text), F.array(F.lit(eos_id))), size)


def shifted(labels_: Column, ends: Column | None = None) -> Column:
    """Labels moved left by one, ignored at the end, and at the ends of sequences given by their places."""
    n = F.size(labels_)
    out = F.transform(V.indices(n), lambda i: F.coalesce(F.get(labels_, i + 1), F.lit(IGNORED)))
    return out if ends is None else F.transform(out, lambda v, i: F.when(F.array_contains(ends, i), F.lit(IGNORED)).otherwise(v))
