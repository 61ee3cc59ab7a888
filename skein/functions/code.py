"""Functions that need Python: shell words, keyed digests, printable text, string leaves; all over Arrow batches."""

from __future__ import annotations

import hashlib
import re
import shlex

import pandas as pd
from pyspark.sql import functions as F

# Programs that run another one named after them.
WRAPPERS = ("sudo", "env", "time", "nohup", "xargs", "command", "exec", "nice")


def programs(command: str | None) -> list[str]:
    """The programs a shell line runs, in order: pipes, lists and substitutions part it, wrappers and assignments are passed
    over. Nothing is run. Text with open quotes is split at blanks."""
    if not command:
        return []
    inner = re.findall(r"\$\(([^()]*)\)|`([^`]*)`", command)
    text = re.sub(r"\$\([^()]*\)|`[^`]*`", "_", command)
    try:
        lex = shlex.shlex(text, posix=True, punctuation_chars="|&;<>()\n")
        lex.whitespace, lex.whitespace_split, lex.commenters = " \t\r", True, ""
        words = list(lex)
    except ValueError:
        words = text.split()
    out, fresh, skip = [], True, False
    for w in words:
        if w and set(w) <= set("|&;()\n"):
            fresh = True
        elif w and set(w) <= set("<>&"):
            skip = True
        elif skip:
            skip = False
        elif fresh and not re.match(r"^[A-Za-z_]\w*=", w):
            name = w.rsplit("/", 1)[-1]
            if name not in WRAPPERS and not (out and w.startswith("-")):
                out.append(name)
                fresh = False
    for a, b in inner:
        out += programs(a or b)
    return out


def shell_programs():
    """A column function: `programs` of each command."""

    @F.pandas_udf("array<string>")
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(programs)

    return run


def keyed_id(secret: str, length: int = 24):
    """A column function: the first digits of the HMAC-SHA256 of a text under a secret; null stays null. Two digests over
    padded keys, so that it stays in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))

    def run(value):
        first = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
        return F.substring(F.sha2(F.concat(outer, first), 256), 1, length)

    return run


def printable(keep: str = "\n\t"):
    """A column function: characters that can't be printed as backslash escapes, but for those kept."""

    def one(text):
        if text is None or (text.isprintable()):
            return text
        return "".join(c if c.isprintable() or c in keep else c.encode("unicode_escape").decode() for c in text)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run
