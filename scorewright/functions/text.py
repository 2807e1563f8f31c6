"""Text functions on decompiled and preprocessed C, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Branch and call instructions whose bare target is an address, and those with a PC-relative immediate.
BRANCHES = (
    "call", "jmp", "loop", "loope", "loopne", "jecxz", "jrcxz", "je", "jne", "jz", "jnz", "jg", "jge", "jl", "jle", "ja", "jae", "jb", "jbe", "jc", "jnc",
    "js", "jns", "jo", "jno", "jp", "jnp", "jpe", "jpo", "jcxz", "b", "bl", "blx", "bx", "beq", "bne", "bcs", "bcc", "bmi", "bpl", "bvs", "bvc", "bhi", "bls",
    "bge", "blt", "bgt", "ble", "cbz", "cbnz",
)
PC_RELATIVE = ("adrp", "adr")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def code_metrics(code: Column) -> tuple[Column, Column]:
    """(gotos, boolean operators)."""
    return occurrences(code, "goto "), occurrences(code, " && ") + occurrences(code, " || ")


def sanitize_c(text: Column) -> Column:
    """C that a graph front end parses: no array return types, no register annotations, no 128-bit integers."""
    bound_before_name = r"(?m)^([^\W\d][ \w]*?)\s*\[[0-9]++\](?=\s+[^\W\d]\w*\s*\()"
    register = r"\s*+@\s*+[a-z]\w++"
    text = F.regexp_replace(F.regexp_replace(text, bound_before_name, "$1"), register, "")
    return F.replace(F.replace(text, F.lit("unsigned __int128"), F.lit("unsigned long long")), F.lit("__int128"), F.lit("long long"))


def is_system_header(path: Column) -> Column:
    return (path == "") | path.startswith("<") | path.startswith("/usr/") | F.contains(path, F.lit("/usr/lib/gcc")) | path.endswith("stdc-predef.h")


def strip_system_headers(text: Column) -> Column:
    """Only the project's own lines of a preprocessed unit.

    The text is cut at line markers, each piece begins with its file name, and pieces of system files go.
    What stands before the first marker is system code.
    """
    pieces = F.split(F.concat(F.lit("\n"), text), r'\n#[ \t]+\d+[ \t]+"')
    own = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: ~is_system_header(F.substring_index(p, '"', 1)))
    bodies = F.transform(own, lambda p: F.regexp_extract(p, r'(?s)^[^"]*"[^\n]*\n?(.*)$', 1))
    return F.concat(F.array_join(F.filter(F.transform(bodies, lambda b: F.regexp_replace(b, r"\n$", "")), lambda b: b != ""), "\n"), F.lit("\n"))


def normalize_operands(mnemonic: Column, operands: Column) -> Column:
    """Operands without what linking decides: PC-relative displacements and direct branch targets."""
    kept = operands
    for base in ("rip", "pc"):
        displaced = r"(?<=\[" + base + r")\s*[-+,]\s*[#-]{0,2}[0-9]\w*\s*(?=\])"
        kept = F.replace(F.regexp_replace(kept, displaced, ""), F.lit(f"[{base}]"), F.lit(f"[{base}+X]"))
    target = mnemonic.isin(*PC_RELATIVE) | mnemonic.isin(*BRANCHES) & ~F.contains(kept, F.lit("["))
    hexadecimal = F.regexp_replace(kept, r"#?-?0x\p{XDigit}++", "X")
    return F.when(target, F.regexp_replace(hexadecimal, r"#?-?[0-9]++", "X")).otherwise(kept)


def drop_padding(lines: Column) -> Column:
    """Instruction lines without nops, and without the zeroing of AL's register just before a call."""
    kept = F.filter(lines, lambda x: (x != "nop") & ~x.startswith("nop "))
    zeroing = lambda x, i: x.isin("mov eax, 0", "xor eax, eax") & F.coalesce(F.get(kept, i + 1).startswith("call "), F.lit(False))
    return F.filter(kept, lambda x, i: ~zeroing(x, i))


def set_jaccard(a: Column, b: Column) -> tuple[Column, Column]:
    """(likeness, lines that differ) of two listings as sets; both empty: alike; one empty: all its lines differ."""
    union, shared = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    one = (F.size(a) == 0) | (F.size(b) == 0)
    like = F.when(union == 0, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(shared / union)
    return like, F.when(one, F.size(a) + F.size(b)).otherwise(union - shared)


def byte_ratio(a: Column, b: Column) -> Column:
    """Share of equal positions of two byte lists, of the longer one's length."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda z: z))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def name_offset(name: Column, offset: Column) -> Column:
    """A slot's offset: given, or read from names such as ``local_28``."""
    digits = F.regexp_extract(name, r"^(?:local|var)_([0-9a-fA-F]+)$", 1)
    return F.coalesce(offset, F.when(digits != "", -F.conv(digits, 16, 10).cast("bigint")))


def function_blocks(text: Column) -> Column:
    """array<struct<name, addr, code>> of a decompiled file: blocks begin with ``// Function: <name> @ 0x<addr>``.

    Of equal names the last counts. Text before the first block is dropped.
    """
    parts = F.filter(F.split(text, r"(?m)^(?=// Function: )"), lambda p: p.startswith("// Function: "))
    head = r"^// Function: (.+?) @ 0x([0-9a-fA-F]+)[^\n]*\n?"
    each = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, head, 1).alias("name"), F.conv(F.regexp_extract(p, head, 2), 16, 10).cast("bigint").alias("addr"), F.trim(F.regexp_replace(F.regexp_replace(p, head, ""), r"^\s+|\s+$", "")).alias("code")))
    good = F.filter(each, lambda x: x["name"] != "")
    later = lambda x, i: F.exists(F.slice(good, i + 2, F.size(good)), lambda y: y["name"] == x["name"])
    return F.filter(good, lambda x, i: ~later(x, i))


def first_identifier(code: Column) -> Column:
    """The first called or defined name in a piece of C, without comments and preprocessor lines."""
    words = ("if", "for", "while", "switch", "return", "sizeof", "do", "else", "case")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " "), r"(?m)^\s*#.*$", " ")
    names = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.get(F.filter(names, lambda n: ~n.isin(*words)), F.lit(0))


def fenced_code(text: Column) -> Column:
    """C from an agent's answer: the first fenced block, else the text."""
    block = F.regexp_extract(text, r"(?s)```(?:c|cpp|C)?\s*\n(.*?)```", 1)
    return F.regexp_replace(F.when(block != "", block).otherwise(text), r"^\s+|\s+$", "")


def artifact_name(spec: Column) -> Column:
    return F.substring_index(spec, "@", 1)


def trace_label(opt: Column, project: Column, stem: Column, function: Column, addr: Column) -> Column:
    return F.concat_ws("__", opt, project, stem, F.concat(function, F.lit("_0x"), F.lower(F.hex(addr))))


#: Fixed values: -f flags, after an optional ``no-``, that change emitted code.
CODEGEN = (
    "omit-frame-pointer", r"zero-call-used-regs=\S+", "trapv", "wrapv", "stack-protector(?:-strong|-all|-explicit)?", r"cf-protection(?:=\S+)?", "PIC", "PIE", "pic", "pie",
    "plt", "common", "short-enums", "signed-char", "unsigned-char", "strict-aliasing", "jump-tables", "delete-null-pointer-checks", "stack-clash-protection",
    "optimize-sibling-calls", "reorder-blocks(?:-and-partition)?", "tree-vectorize", "unroll-loops", "finite-math-only", "fast-math", "math-errno", "trapping-math",
    "signed-zeros", "associative-math", "reciprocal-math", "unsafe-math-optimizations", "single-precision-constant", "float-store", r"excess-precision=\S+",
)


def codegen_flags(producer: Column) -> Column:
    """Flags of a producer string that change generated code: -m, -O and the known -f flags; the assembler's syntax doesn't."""
    words = F.split(F.trim(producer), r"\s+")
    one = "^(?:-m(?:arch|tune|cpu|thumb|float-abi|fpu|abi)?=?.*|-O[0-3sgz]?|-f(?:no-)?(?:" + "|".join(CODEGEN) + "))$"
    return F.filter(words, lambda w: w.rlike(one) & ~w.startswith("-masm"))
