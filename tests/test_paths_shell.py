"""Path expressions and command reading against small Python models."""

import posixpath
import random

from pyspark.sql import functions as F

from tracewarden.functions import paths, rules, shell

T = F.col("t")


def _normal(path):
    if not path:
        return "."
    clean = posixpath.normpath(path)
    if clean.startswith("//"):
        clean = clean[1:]
    if path.endswith("/") and not clean.endswith("/"):
        clean += "/"
    return clean


def _random_paths(count):
    rng = random.Random(7)
    pieces = ["a", "b", ".", "..", "", "c.txt", "~", "..."]
    out = ["", "/", "//", ".", "..", "./", "../", "/..", "/./", "a//b/"]
    for _ in range(count):
        out.append("/".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))))
    return out


def test_normalize_random(apply):
    values = _random_paths(1500)
    assert apply(paths.normalize_path(T), *values) == [_normal(v) for v in values]


def test_resolve_random(apply):
    values = _random_paths(800)
    want = []
    for v in values:
        full = _normal(v if v.startswith("/") else "/w/d/" + v)
        want.append(full if full == "/" else full.rstrip("/"))
    assert apply(paths.resolve_against(F.lit("/w/d"), T), *values) == want


def test_relative_random(apply):
    values = [v for v in _random_paths(800) if v.startswith("/")]
    want = [posixpath.relpath(_normal(v), "/a/b") for v in values]
    got = apply(paths.relative_path(T, F.lit("/a/b")), *values)
    assert got == ["" if w == "." else w for w in want]


def test_candidate_resolution(apply):
    got = apply(
        paths.resolve_candidate(T, F.lit("/w"), F.lit("/home/u")),
        "/x/../y", "a/../b", "~", "~/n//m", "~user/x", "./c/",
    )
    assert got == ["/x/../y", "/w/b", "/home/u", "/home/u/n/m", "/w/~user/x", "/w/c"]


def test_base_dir_order(spark):
    frame = spark.createDataFrame(
        [("/c", ["/r"]), ("", ["/r"]), (None, []), (None, None)], "cwd string, roots array<string>"
    )
    rows = frame.select(paths.base_dir(F.col("cwd"), F.col("roots"), F.lit("/p")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["/c", "/r", "/p", "/p"]


def test_escape(apply):
    got = apply(paths.escapes_base(T, F.lit("/base/dir")), "a", "../x", "../dir2", "/abs", "", ".", "//", "a/../..")
    assert got == [False, True, True, True, False, False, False, True]


def test_predicates_and_stripping(apply):
    values = ["a/b", "-x", "*.c", ".env", "~", "a", "x[1]/y", ""]
    assert apply(paths.looks_like_path(T), *values) == [True, False, False, True, True, False, False, False]
    names = ["a.txt", "-a.b", "a", "a/b.c", "x" * 251 + ".txt", "x" * 252 + ".txt"]
    assert apply(paths.looks_like_bare_file(T), *names) == [True, False, False, False, True, False]
    raw = [' "(a)", ', "<[x]>;:", "a", "\"'"]
    assert apply(paths.strip_quoting(T), *raw) == ["a", "x", "a", ""]
    assert apply(paths.is_env_assignment(T), "A_1=x", "1A=x", "=x") == [True, False, False]


# --- model of the token walk ----------------------------------------------------


def _model_tokens(command):
    tokens, word, i = [], "", 0
    quote = ""
    while i < len(command):
        c = command[i]
        nxt = command[i + 1] if i + 1 < len(command) else ""
        if quote == "'":
            quote, word = ("", word) if c == "'" else (quote, word + c)
        elif quote == '"':
            if c == '"':
                quote = ""
            elif c == "\\" and nxt:
                word, i = word + nxt, i + 1
            else:
                word += c
        elif c in "'\"":
            quote = c
        elif c.isspace() or c in "|&;<>":
            if word:
                tokens.append(word)
            word = ""
            if not c.isspace():
                double = c in "|&<>" and nxt == c
                tokens.append(c + nxt if double else c)
                i += double
        elif c == "\\" and nxt:
            word, i = word + nxt, i + 1
        else:
            word += c
        i += 1
    return tokens + ([word] if word else [])


def _pathlike(t):
    return bool(t) and t[0] != "-" and not set(t) & set("*?[") and ("/" in t or t[0] in ".~")


def _model_paths(tokens):
    out, reading, operand = [], False, False
    for t in tokens:
        if operand:
            out += [t] if _pathlike(t) else []
            operand = False
        elif t in rules.SEPARATOR_TOKENS:
            reading = False
        elif not reading:
            reading = t.lower() in rules.READ_COMMANDS
        elif t in rules.REDIRECT_TOKENS:
            operand = True
        elif _pathlike(t):
            out.append(t)
    return list(dict.fromkeys(out))


def _random_commands(count):
    rng = random.Random(11)
    bits = [
        "cat", "Grep", "rg", "sudo", "A=1", "./a", "b/c.txt", "'q x'", '"d \\" e"', "\\ ", "|", "||", "&&",
        ";", "&", "<", "<<", ">", ">>", "-n", "*", "~/x", "''", " ", "  ", "\n", "\t", "'", '"', "\\", "x.y",
    ]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def test_tokens_random(apply):
    values = _random_commands(2500)
    assert apply(shell.shell_tokens(T), *values) == [_model_tokens(v) for v in values]


def test_token_paths_random(apply):
    values = _random_commands(2500)
    got = apply(shell.paths_by_tokens(shell.shell_tokens(T)), *values)
    assert got == [_model_paths(_model_tokens(v)) for v in values]


def test_candidates_of_known_commands(apply):
    got = apply(
        shell.read_candidates(T), "cat src/a.ts", "echo cat ./f", "cat apikey.txt", "python t.py",
        "sort < ./in > ./out", "  ",
    )
    assert got == [
        ["src/a.ts", "/a.ts", "a.ts"], ["./f"], ["apikey.txt"], ["t.py"], ["./in", "./out"], [],
    ]


def test_long_words_do_not_overflow(apply):
    long_word = "x" * 300_000
    assert apply(F.size(shell.shell_tokens(T)), f'cat "{long_word}" {long_word}') == [3]
