"""Names of functions and files as they come from binaries: normal forms and tests. All are columns; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of names that tools make up, matched whole against the part after the last `::`.
DEFAULT_NAMES = (
    r"sub_[0-9a-fA-F]+",
    r"FUN_[0-9a-fA-F]+",
    r"fcn\.[0-9a-fA-F]+",
    r"func_[0-9a-fA-F]+",
    r"j_.*",
    r"(?i:data|DAT|byte|BYTE|dword|DWORD|qword|QWORD)_[0-9a-fA-F]+",
    r"(?:var|local|uVar|iVar|lVar|pVar|cVar|bVar|sVar|auVar|puVar)_?[0-9]*",
    r"(?:arg|param)_?[0-9]+",
    r"a[1-9]",
)

#: A made-up name as one pattern.
DEFAULT_PATTERN = "^(?:" + "|".join(DEFAULT_NAMES) + ")$"


def without_decoration(name: Column) -> Column:
    """Without a trailing @N of digits, unless nothing would be left."""
    return F.regexp_replace(name, "^(.+)@[0-9]+$", "$1")


def api_name(name: Column) -> Column:
    """Without __imp_, all leading underscores (one sign stays) and @N."""
    return without_decoration(F.regexp_replace(F.regexp_replace(name, "^__imp_", ""), "^_+(.)", "$1"))


def external_name(name: Column) -> Column:
    """Without __imp_, at most two leading underscores and @N; null is `unknown`."""
    return without_decoration(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("unknown")), "^__imp_", ""), "^_{1,2}(.)", "$1"))


def thunk_name(name: Column) -> Column:
    """As external_name, also without thunk_; null is `unknown_thunk`."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("unknown_thunk")), "^__imp_", "")
    return without_decoration(F.regexp_replace(F.regexp_replace(plain, "^thunk_", ""), "^_{1,2}(.)", "$1"))


def library_name(name: Column) -> Column:
    """Without a library (`X::` or `X.dll_`), an import mark, leading underscores and @N."""
    at = F.instr(name, "::")
    plain = F.when(at > 1, F.substring(name, at + 2, F.length(name))).otherwise(name)
    has_dll = plain.contains(".DLL_") | plain.contains(".dll_")
    dll = F.instr(F.lower(plain), ".dll_")
    plain = F.when(has_dll & (dll > 1), F.substring(plain, dll + 5, F.length(plain))).otherwise(plain)
    return api_name(F.regexp_replace(plain, "^<EXTERNAL>::", ""))


def is_default(name: Column) -> Column:
    """Whether a name is missing or made up by a tool."""
    simple = F.when(name.endswith("::"), name).otherwise(F.element_at(F.split(name, "::"), -1))
    return name.isNull() | (name == "") | F.coalesce(simple.rlike(DEFAULT_PATTERN), F.lit(False))


def label(kind: Column, name: Column, address: Column, id_: Column) -> Column:
    """What a node is called on a screen: its name, else type and hex address, else type and the id's first 8 signs."""
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(address)))
    return F.coalesce(name, F.concat_ws(" ", kind, hexed).alias("x"), F.concat_ws(" ", kind, F.substring(id_, 1, 8)))


def hex_address(text: Column) -> Column:
    """The number that a hex address stands for, with or without 0x; 0 for what is none."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def qualified(scopes: Column, name: Column) -> Column:
    """Scopes and name joined by `::`; scopes in angle brackets and empty ones are left out."""
    return F.array_join(F.concat(F.filter(scopes, lambda s: ~s.startswith("<") & (s != "")), F.array(name)), "::")


def suggests_network(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("socket|connect|send|recv|http|download|upload|network|client|server"), F.lit(False))


def suggests_file(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("file|read|write|open|save|load|config|log"), F.lit(False))


def flag_form(flag: Column) -> Column:
    """A flag as it is stored: upper case, underscores for blanks."""
    return F.replace(F.upper(F.trim(flag)), F.lit(" "), F.lit("_"))
