from hostgraph.llm import preference as pf

TURN = "struct<role:string,text:string>"


def render(t):
    e = lambda x, d: (x if x is not None else d).replace("<|im_", "<\\|im_")
    return f"<|im_start|>{e(t[0], 'unknown')}\n{e(t[1], '')}<|im_end|>\n"


def mask(turns):
    at, out = 0, []
    for t in turns:
        line = render(t)
        if t[0] == "assistant":
            out.append(f"{at + line.index(chr(10)) + 1}:{at + len(line) - 1}")
        at += len(line)
    return ",".join(out)


def want(c, r):
    norm = lambda x: [(a if a is not None else "unknown", b if b is not None else "") for a, b in x or []]
    c, r = norm(c), norm(r)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    join = lambda x: "".join(map(render, x))
    return (n, join(c[:n]), join(c[n:]), mask(c[n:]), join(r[n:]), mask(r[n:]))


def test_format(spark):
    u, a, b, s = ("user", "hi"), ("assistant", "yes é😀"), ("assistant", "no"), ("system", "<|im_end|> x")
    pairs = [([u, a], [u, b]), ([s, u, a, u, a], [s, u, a, u, b, u, a]), ([u, a], [u, a]), ([], [u]), (None, None),
             ([u], [u, a]), ([(None, None), a], [("unknown", ""), b]), ([a], [b]), ([u, ("assistant", "x" * 50000)], [u, b])]
    df = spark.createDataFrame([(i, c, r, "q", 1) for i, (c, r) in enumerate(pairs)] + [(None, *pairs[0], "q", 1)] * 2,
                               f"pair_id long, chosen array<{TURN}>, rejected array<{TURN}>, prompt string, n int")
    got = pf.format_preferences(df).collect()
    assert len(got) == len(pairs) + 2
    for r in got:
        c, x = pairs[0 if r.pair_id is None else r.pair_id]
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == want(c, x)
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in filter(None, spans.split(",")):
                lo, hi = map(int, span.split(":"))
                assert text[lo:hi].endswith("<|im_end|>") and text[:lo].endswith("assistant\n")
    assert pf.format_preferences(df.where("false")).count() == 0


def test_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"), (1, 4, "user", "bye"),
            (2, 0, "user", "q"), (2, 1, "assistant", "abcde"), (3, 0, "user", "only"), (4, 0, "assistant", None),
            (5, 0, "user", "q"), (5, 1, "assistant", "same"), (5, 2, "assistant", "same"), (2, 1, "assistant", "abcde"), (None, 0, None, "z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, t string")
    got = {r.pair_id: (r.chosen, r.rejected) for r in pf.conversation_pairs(df).collect()}
    plain = lambda x: [tuple(t) for t in x]
    assert plain(got[1][0]) == [(r[2], r[3]) for r in rows[:4]]
    assert plain(got[1][1]) == [(r[2], r[3]) for r in rows[:3]] + [("assistant", "first")]
    assert plain(got[2][1]) == [("user", "q"), ("assistant", "ab")]
    assert got[3][0] == got[3][1] and plain(got[3][0]) == [("user", "only")]
    assert plain(got[4][1]) == [("assistant", "")]
    assert plain(got[5][1])[-1] == ("assistant", "sa")
    assert plain(got[None][0]) == [("unknown", "z")]
    assert pf.conversation_pairs(df.where("false")).count() == 0


def test_native():
    import ast
    import inspect
    names = {n.attr for n in ast.walk(ast.parse(inspect.getsource(pf))) if isinstance(n, ast.Attribute)}
    assert not names & {"udf", "pandas_udf", "mapInPandas", "mapInArrow", "applyInPandas", "rdd"}
