"""Cases of syntax that were judged wrongly once, and Python against its compiler on
files that were broken on purpose."""

import ast
import glob
import random
import re
import warnings

import pytest

from twinfold.llm.syntax import check

# fmt: off
MORE_VALID = {"ts":["namespace X.Y {}", "module X.Y {}", "declare namespace A.B.C {}", "let x: A<B>= 1", "type M<T>={a:T}", "@a.b class C {}","let a = b >= c >> d >>> e; a >>= 1; a >>>= 2;","function f<T extends A<B>= C>(x: A<B>= y) {}", "class A { x: B<C>= 1 }", "for (const x of y as B<C>) {}","let z = a < b || c > d;","const f = async (a: A<B<C>>): Promise<B<C>>=> 1","declare const x: number; export declare const y: A<B>;","const {a, b}: T = c; let q;","if (a>=b) {}","x = <T>y","new Map<string, Set<number>>()","import A = B.C;"],
"js":["@a.b.c class C {}","const x = 1, [y] = z; for (const q of r) ; for (const k in o) ; for (let i;;) ; let u, v = 2","let s = '\\u{1F600}\\x41\\u0041'","a = '\\\\x'"],
"java":["void main(){}","import a.b;\nint x = 1;\nvoid main() { f(); }\nclass A {}", "class A { public static void main(String[] a) {} }"],
"c":['int f(){printf("%" PRIu64 "\\n", x);}','#ifdef __cplusplus\nextern "C" {\n#endif\nint x;\n#ifdef __cplusplus\n}\n#endif\n','#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n return a; }\n','#ifdef A\nint x;\n#elif defined(B)\nint y;\n#else\nint z;\n#endif\n',
 '#ifdef W\n if_w(\n#else\n if_x(\n#endif\nint a);\n#ifdef W\nint q;\n#else\nint r;\n#endif\n'.replace(' if_w(','int f(').replace(' if_x(','int g('),"int x = sizeof(T) * 2, *p = (T *)q; void f(void) { if (a) *p = 1; while (b) -c; x = (d) + 1; y = (T)(z) - 1; return (r) & 3; }","#if 0\n(((\n#endif\nint x;","f(a) * b;".replace("f(a) * b;","int q(void) { return f(a) * b + g(c) - d; }"),"#if defined(X) && !defined(Y)\nint a;\n#else\nint b;\n#endif","#ifndef G_H\n#define G_H\n#ifdef A\nint a;\n#else\nint b;\n#endif\n#endif"]}
MORE_INVALID = {"js":["const x;","const x, y = 1;","let {a};","a = '\\u12'","var [b];"],"ts":["a = b > = c","const x;","let x: A<B = 1"],"java":["int x = 1;","void main() {","package a; void main(){}"],"c":['#ifdef A\nint x;\n#else\nint y\n#endif\n','#if A\nint x;\n#elif B\nint (;\n#endif','int f(){printf("%d" a);}','#ifdef A\nint x;\n#else\nint y;\n','#else\n','#ifdef A\nint x;\n#ifdef B\nint y;\n#else\n((\n#endif\n#endif\n','#ifndef A\nint x;\n#else\n"abc\n#endif\n']}
# fmt: on
PYTHON = [
    "f(a=1, 2)", "def f(a=1, b): pass", "def f(*): pass", "def f(**a, b): pass", "f(**a, *b)", "[*a for a in b]", "(a, b): int = 1", "f(x for x in y, 1)", "del *a", "(*a)", "b'a' 'b'", "'\\x1'", "'\\u12'", "b'\xe9'",
    "try:\n pass\nexcept* A:\n pass\nexcept B:\n pass", "lambda a=1, b: 0", "lambda *: 0", "class A(x for x in y): pass", "def f(a, /, b, /): pass", "def f(/): pass", "[a, b] += 1", "1if x else 2", "f(a, b=1, *c, **d, e=2)",
    "def f(a, b=1, /, c=2, *d, e, f=1, **g): pass", "x = [a for b in c if d]", "f(*a, b, c=1)", "lambda a, /, b=1, *, c: 0", "for x, *y in z: pass", "with (a as b, c): pass", "f(a for a in b)", "f(**a, b=1)", "del (a, b), [c]",
    "x: int", "(x): int = 1", "a.b: int = 2", "[0x1for x in y]", "def f(*args,): pass", "f(a,)", "f(a for a in b,)",
]


@pytest.mark.parametrize("ext", sorted(MORE_VALID))
def test_more_cases(ext):
    for s in MORE_VALID[ext]:
        assert check(ext, s) is None, (s, check(ext, s))
    for s in MORE_INVALID.get(ext, ()):
        assert check(ext, s) is not None, s


def compiles(src):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(src)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("src", PYTHON)
def test_python_statements(src):
    assert (check("py", src + "\n") is None) == compiles(src)


def broken(src, rng):
    lines, c = src.split("\n"), rng.randrange(len(src))
    i, how = rng.randrange(len(lines)), rng.randrange(6)
    if how == 0:
        return src[:c]
    if how == 1:
        return src[:c] + src[c + 1 :]
    if how == 2:
        return src[:c] + rng.choice("()[]{}:,=*.'\"\n +-@") + src[c:]
    if how == 3:
        return "\n".join(lines[:i] + lines[i + 1 :])
    if how == 4:
        return "\n".join(lines[:i] + ["======="] + lines[i:])
    x = rng.choice(list(re.finditer(r"\w+|[^\w\s]", src)))
    return src[: x.start()] + src[x.end() :]


def test_python_agrees_with_the_compiler_on_broken_files():
    rng, seen = random.Random(5), {True: 0, False: 0}
    for f in sorted(glob.glob("/opt/py313/lib/python3.13/*.py"))[:40]:
        src = open(f, encoding="utf8", errors="replace").read()
        if not 0 < len(src) < 30_000:
            continue
        for _ in range(6):
            s = broken(src, rng)
            want = compiles(s)
            seen[want] += 1
            assert (check("py", s) is None) == want, (f, check("py", s))
    assert min(seen.values()) > 20
