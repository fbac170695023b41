"""Which lexer and grammar a file extension stands for, and the check itself."""

from __future__ import annotations

from . import tables
from .python_grammar import LexError

EXTENSIONS = {
    **dict.fromkeys(("py", "pyi"), "python"),
    **dict.fromkeys(("js", "mjs", "cjs"), "javascript"),
    **dict.fromkeys(("ts", "mts"), "typescript"),
    "java": "java",
    "go": "go",
    **dict.fromkeys(("c", "h"), "c"),
    "rs": "rust",
    "rb": "ruby",
}
_BUILT: dict[str, tables.Tables] = {}
_MACHINES: dict[str, tables.Machine] = {}


def _module(lang: str):
    import importlib

    return importlib.import_module(f"{__package__}.{lang}_grammar")


def grammar(lang: str) -> tables.Tables:
    if lang not in _BUILT:
        _BUILT[lang] = tables.build(_module(lang).GRAMMAR, getattr(_module(lang), "PREFER_SHIFT", ()))
    return _BUILT[lang]


def machine(lang: str) -> tables.Machine:
    built = grammar(lang)
    if lang not in _MACHINES or _MACHINES[lang].tables is not built:
        _MACHINES[lang] = tables.Machine(built)
    return _MACHINES[lang]


def warm() -> dict[str, tables.Tables]:
    """The tables of all languages, to be handed to the workers."""
    return {lang: grammar(lang) for lang in sorted(set(EXTENSIONS.values()))}


def install(built: dict[str, tables.Tables]) -> None:
    _BUILT.update(built)


def check(ext: str, src: str) -> tuple[int, str] | None:
    """None if `src` is valid, else (line, what stands there) of the first error."""
    lang = EXTENSIONS[ext]
    mod, m = _module(lang), machine(lang)
    try:
        for toks, at, *rest in mod.readings(src) if hasattr(mod, "readings") else (mod.tokenize(src),):
            bad = tables.parse(m, toks, rest[0] if rest else None)
            if bad >= len(toks):
                return src.count("\n") + 1, "end of file"
            if bad >= 0:
                return src.count("\n", 0, at[bad]) + 1, toks[bad]
            for inner, places in rest[1] if len(rest) > 1 else ():  # programs inside strings
                if (k := tables.parse(m, inner, None)) >= 0:
                    return src.count("\n", 0, places[min(k, len(places) - 1)]) + 1, inner[k] if k < len(inner) else "}"
    except LexError as e:
        return src.count("\n", 0, e.at) + 1, "token"
    return None
