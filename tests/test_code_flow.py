"""Register accesses, usage chains and propagation along calls, against plain Python."""

import random

from tesserine.operators import dataflow
from tesserine.sources import c_access


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_register_accesses_by_place_in_the_statement():
    text = """void f(void)
{
    /* AdcSFR->NOT.U = 1; */ const char *s = "AdcSFR->NOT.U = 1;"; // AdcSFR->NOT.U
    AdcSFR->CLC.U = 0x1u;
    x = AdcSFR->STAT.B.RDY & (1u << 3);
    AdcSFR->CTRL[i].U |= (uint32)(1u << n);
    AdcSFR->LONG[a[b]].B.EN <<= 2;
    while ((AdcSFR->STAT.U & MASK) == 0u) { ; }
    AdcSFR->A.U = AdcSFR->B2.U
        + DmaChSFR->C.U;
    if (AdcSFR->D.U == 3) { AdcSFR->E.U++; --AdcSFR->F.U; }
    Dma_RegBasePtr[n]->PROTSE.U = 1;
    y = Dma_RegBasePtr[n].ACCGRP[k].PROTE.B.LCK;
    DRV_SFRWRITE(AdcSFR->DATA.U, AdcSFR->SRC.U);
    z = DRV_SFRREAD(4, AdcSFR->FIFO.U);
    DRV_SFRWRITE(EvadcCh->CH[c].CFG.U, DRV_SWPMSK((volatile uint32 *)&AdcSFR->MSK.U, AdcSFR->V.U, mask));
    ADC_SFR_RUNTIME_WRITE32(MODULE.KRST.U, 1u);
    ADC_SFR_INIT_DEINIT_READ(AdcSFR->OUT.B.X);
    plain->REG.U = 4; AdcSFR->NOVIEW = 3; AdcSFR->
"""
    want = [
        ("CLC", "U", "WRITE", 4), ("STAT", "RDY", "READ", 5), ("CTRL[i]", "U", "READ", 6), ("CTRL[i]", "U", "WRITE", 6), ("LONG[a[b]]", "EN", "READ", 7), ("LONG[a[b]]", "EN", "WRITE", 7),
        ("STAT", "U", "READ", 8), ("A", "U", "WRITE", 9), ("B2", "U", "READ", 9), ("C", "U", "READ", 10), ("D", "U", "READ", 11), ("E", "U", "READ", 11), ("E", "U", "WRITE", 11),
        ("F", "U", "READ", 11), ("F", "U", "WRITE", 11), ("PROTSE", "U", "WRITE", 12), ("ACCGRP_PROTE", "LCK", "READ", 13), ("DATA", "U", "WRITE", 14), ("SRC", "U", "READ", 14), ("FIFO", "U", "READ", 15),
        ("CH[c].CFG", "U", "WRITE", 16), ("MSK", "U", "READ", 16), ("MSK", "U", "WRITE", 16), ("V", "U", "READ", 16), ("MODULE.KRST", "U", "WRITE", 17), ("OUT", "U", "READ", 18),
    ]
    assert c_access.accesses(text) == want
    assert c_access.accesses("") == c_access.accesses("((([[ AdcSFR->X[") == []


def test_register_accesses_of_rows(spark):
    rows = frame(spark, [(1, "AdcSFR->A.U = 1;\nAdcSFR->A.U += 1;"), (2, None), (3, ""), (1, "AdcSFR->A.U = 1;")], "function_id int, body string")
    assert sorted(tuple(r) for r in c_access.register_accesses(rows).collect()) == [(1, "A", "U", "READ", 2), (1, "A", "U", "WRITE", 1), (1, "A", "U", "WRITE", 1), (1, "A", "U", "WRITE", 2)]


def test_register_edges_match_or_create(spark):
    accesses = frame(
        spark,
        [("f", "adc", "CH[i].CFG", "U", "READ"), ("f", "adc", "CH[j].CFG", "A", "READ"), ("f", "adc", "STAT", "U", "WRITE"), ("f", "spi", "STAT", "U", "WRITE"), ("g", "spi", "ADC_STAT", "U", "READ"), ("g", "adc", "U", "U", "READ"), ("g", "adc", "NEW.ONE", "U", "READ"), ("h", "adc", "GRP1_X", "U", "READ")],
        "function_id string, module string, register string, field string, access_type string",
    )
    registers = frame(spark, [("ADC_CH0_CFG", "adc"), ("ADC_CH1_CFG2", "adc"), ("ADC_STAT", "adc"), ("ADC_STAT1", "adc"), ("ADC_CHX_CFG", "adc"), ("ADC_GRP12_X", "adc"), ("ADC_GRP2_X", "adc"), ("SPI_CH0_CFG", "spi")], "name string, module string")
    got = {tuple(r) for r in dataflow.register_edges(accesses, registers).collect()}
    assert got == {
        ("f", "ADC_CH0_CFG", "READ", "A", False), ("f", "ADC_CH1_CFG2", "READ", "A", False), ("f", "ADC_STAT", "WRITE", "U", False), ("f", "STAT", "WRITE", "U", True), ("g", "ADC_STAT", "READ", "U", False),
        ("g", "NEW_ONE", "READ", "U", True), ("h", "ADC_GRP12_X", "READ", "U", False),
    }


def test_chains_lead_to_their_variable(spark):
    uses = frame(
        spark,
        [
            ("f", "Drv_State.core[i].regs->mode", "READ", None), ("f", "p->mode", "WRITE", None), ("f", "q.mode", "WRITE", None), ("f", "(*r).x", "READ", None), ("g", "p->mode", "READ", None),
            ("g", "Drv_State.core[2].regs->mode", "READ", "CALL"), ("g", "Count", "WRITE", None), ("g", "Count", "WRITE", None), ("g", "&Drv_State.other.deep", "READ", None), ("h", "loop->x", "READ", None), ("h", "unknown.x", "READ", None),
        ],
        "function_id string, chain string, access_type string, context string",
    )
    variables = frame(spark, [("v1", "Drv_State", "State"), ("v2", "Count", "int"), ("v9", "Count", "int")], "variable_id string, name string, type string")
    aliases = frame(spark, [("f", "p", "&Drv_State.core[0].regs"), ("f", "q", "*p"), ("f", "r", "q"), ("h", "loop", "loop2"), ("h", "loop2", "loop")], "function_id string, local string, chain string")
    members = frame(spark, [("State", "core", "Core"), ("Core", "regs", "Regs"), ("Regs", "mode", "uint8"), ("State", "other", "uint32")], "type string, member string, member_type string")
    resolved = dataflow.resolve_chains(uses, variables, aliases, members)
    got = {tuple(r) for r in resolved.collect()}
    assert ("f", "v1", "core.regs.mode", "uint8", "q.mode", "WRITE", "ALIAS") in got and ("f", "v1", "core.regs", "Regs", "(*r).x", "READ", "ALIAS") in got
    edges = {tuple(r) for r in dataflow.usage_edges(resolved).collect()}
    assert edges == {
        ("f", "v1", "core.regs.mode", "READ_WRITE", "ALIAS,DIRECT", "Drv_State.core[i].regs->mode", 3), ("f", "v1", "core.regs", "READ", "ALIAS", "(*r).x", 1),
        ("g", "v1", "core.regs.mode", "READ", "CALL", "Drv_State.core[2].regs->mode", 1), ("g", "v2", "", "WRITE", "DIRECT", "Count", 2), ("g", "v1", "other", "READ", "DIRECT", "&Drv_State.other.deep", 1),
    }


def plain_reach(start, calls, most, cases):
    cased = {}
    for a, b, label in calls:
        if label:
            cased.setdefault(a, set()).add(b)
    closed = {a for a, to in cased.items() if len(to) >= 2} if cases != "follow" else set()
    found, front = {}, [start]
    for depth in range(1, most + 1):
        after = []
        for at in front:
            if at in closed and at != start:
                continue
            for a, b, label in calls:
                if a == at and b != start and b not in found and not (cases == "own" and at == start and start in closed and label and not any(x == (a, b) and not lab for *x, lab in ((c, d, e) for c, d, e in calls) if tuple(x) == (a, b))):
                    found[b] = depth
                    after.append(b)
        front = after
    return found


def plain_propagation(public, calls, accesses, constants, parameters, branches, most=4):
    name_of = {(f, p): n for f, p, n in parameters}
    out = set()
    for api in public:
        flows, wide = plain_reach(api, calls, most, "own"), {api, *plain_reach(api, calls, most, "follow")}
        direct = {(t, m) for n, t, m, _, c, _ in accesses if n == api and m and (c or "DIRECT") in dataflow.OWN_CONTEXTS}
        existing = {(t, m, a) for n, t, m, a, _, _ in accesses if n == api and m}
        best = {}
        for callee, depth in flows.items():
            tested = [b for b in branches if b[0] == callee and b[2] and b[1] != "B0"]
            given = [(name_of.get((callee, p)), v) for c, e, p, v in constants if e == callee and c in wide]
            taken = None
            if tested and given:
                taken = {"B0"}
                for _, branch, param, op, value, is_else, chain in tested:
                    values = {v for n, v in given if n == param}
                    if len(values) != 1:
                        taken.add(branch)
                        continue
                    (v,) = values
                    if is_else:
                        holds = not any(o == "==" and w == v for _, _, _, o, w, _, c in tested if c == chain)
                    else:
                        holds = {"==": value == v, "!=": value != v}.get(op, True)
                    if holds:
                        taken.add(branch)
            mine = {}
            for n, t, m, a, _, b in accesses:
                if n == callee and m and (taken is None or (b or "B0") in taken) and (t, m) not in direct:
                    mine.setdefault((t, m), set()).add(a)
            for key, kinds in mine.items():
                if {"READ", "WRITE"} <= kinds and "READ_WRITE" not in kinds:
                    kinds = {"READ_WRITE"}
                for a in kinds:
                    if (*key, a) not in existing:
                        best[*key, a] = min(best.get((*key, a), (99, "")), (depth, callee))
        for t, m in {k[:2] for k in best}:
            a = next(x for x in ("READ_WRITE", "WRITE", "READ") if (t, m, x) in best)
            depth, callee = best[t, m, a]
            out.add((api, t, m, a, callee, depth))
    return out


def test_propagation_equals_a_walk(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        names = [f"f{i}" for i in range(26)]
        calls = [(rnd.choice(names), rnd.choice(names), rnd.choice([None, None, "", "1", "2"])) for _ in range(48)]
        accesses = [(rnd.choice(names), rnd.choice("GH"), rnd.choice(["a", "b", "c", "", None]), rnd.choice(["READ", "WRITE", "READ", "READ_WRITE"]), rnd.choice([None, "DIRECT", "ALIAS"]), rnd.choice([None, "B0", "B1", "B2", "B3"])) for _ in range(70)]
        parameters = [(f, p, f"p{p}") for f in names for p in range(2) if rnd.random() < 0.8]
        constants = [(a, b, rnd.randrange(2), rnd.choice("012")) for a, b, _ in calls if rnd.random() < 0.7]
        branches = [(f, f"B{k}", rnd.choice(["p0", "p0", "p1", None]), rnd.choice(["==", "==", "!=", ">"]) if k < 3 else None, rnd.choice("012") if k < 3 else None, k == 3, "x") for f in names[:18] for k in range(4)]
        public = names[::2]
        got = dataflow.propagate(
            frame(spark, [(x,) for x in public], "node string"), frame(spark, calls, "caller string, callee string, case_label string"),
            frame(spark, accesses, "node string, target string, member string, access_type string, context string, branch_id string"), frame(spark, constants, "caller string, callee string, position int, value string"),
            frame(spark, parameters, "function_id string, position int, name string"), frame(spark, branches, "callee string, branch_id string, param string, op string, value string, is_else boolean, chain string"),
        )
        want = plain_propagation(public, calls, accesses, constants, parameters, branches)
        assert {tuple(r) for r in got.collect()} == want and want


def plain_registers(public, calls, accesses, most=5):
    out = {}
    for api in public:
        rows = [(True, r, a, f) for at in plain_reach(api, calls, most, "closed") for n, r, a, f in accesses if n == at] + [(False, r, a, f) for n, r, a, f in accesses if n == api]
        for r, a in {x[1:3] for x in rows}:
            fields = lambda own: [x[3] for x in rows if x[1:3] == (r, a) and x[3] and not (own and x[0])]  # noqa: E731, B023
            out[api, r, a] = (min(fields(True) or fields(False), default=None), all(x[0] for x in rows if x[1:3] == (r, a)))
    return {(*k, *v) for k, v in out.items()}


def test_propagation_equals_a_walk_in_many_graphs(spark):
    """Rings of public functions, and entries (e) that nobody calls, many of which call the same."""
    rows, want, want_registers = {k: [] for k in ("public", "calls", "accesses", "constants", "parameters", "branches", "registers")}, set(), set()
    for seed in range(40):
        rnd = random.Random(seed)
        names, entries = [f"{seed}f{i}" for i in range(9)], [f"{seed}e{i}" for i in range(8)]
        calls = [(a, rnd.choice(names), rnd.choice([None, None, "", "1", "2"])) for a in rnd.choices(names, k=14)] + [(a, b, None) for a, b in zip(names, names[1:] + names[:1]) if seed % 3 == 0]
        calls += [(e, names[rnd.randrange(2)], rnd.choice([None, None, "1"])) for e in entries for _ in range(rnd.choice([1, 1, 1, 2]))]
        accesses = [(rnd.choice(names + entries), rnd.choice("GH"), rnd.choice(["a", "b", "c", ""]), rnd.choice(["READ", "WRITE", "READ", "READ_WRITE"]), rnd.choice([None, "DIRECT", "ALIAS", "ALIAS"]), rnd.choice([None, "B0", "B1", "B2", "B3"])) for _ in range(32)]
        parameters = [(f, p, f"p{p}") for f in names for p in range(2) if rnd.random() < 0.8]
        constants = [(a, b, rnd.randrange(2), rnd.choice("01")) for a, b, _ in calls if rnd.random() < 0.4]
        branches = [(f, f"B{k}", rnd.choice(["p0", "p0", "p1", None]), rnd.choice(["==", "==", "!=", ">"]) if k < 3 else None, rnd.choice("012") if k < 3 else None, k == 3, "x") for f in names[::2] for k in range(4)]
        registers = [(rnd.choice(names + entries[:3]), rnd.choice("RST"), rnd.choice(["READ", "WRITE"]), rnd.choice(["A", "B", "C", None])) for _ in range(8)]
        public = names[::2] + entries
        for k, new in (("public", [(x,) for x in public]), ("calls", calls), ("accesses", accesses), ("constants", constants), ("parameters", parameters), ("branches", branches), ("registers", registers)):
            rows[k] += new
        want |= plain_propagation(public, calls, accesses, constants, parameters, branches)
        want_registers |= plain_registers(public, calls, registers)
    schemas = {
        "public": "node string", "calls": "caller string, callee string, case_label string", "accesses": "node string, target string, member string, access_type string, context string, branch_id string", "constants": "caller string, callee string, position int, value string",
        "parameters": "function_id string, position int, name string", "branches": "callee string, branch_id string, param string, op string, value string, is_else boolean, chain string", "registers": "node string, register string, access_type string, field string",
    }
    g = {k: frame(spark, rows[k], schema) for k, schema in schemas.items()}
    got = [tuple(r) for r in dataflow.propagate(*(g[k] for k in ("public", "calls", "accesses", "constants", "parameters", "branches"))).collect()]
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in dataflow.propagate_registers(g["public"], g["calls"], g["registers"]).collect()]
    assert len(got) == len(want_registers) and set(got) == want_registers


def _hub(spark, n=60):
    """As many entries as callees, all through one function."""
    calls = [(f"e{i}", "hub", None) for i in range(n)] + [("hub", f"c{i}", None) for i in range(n)]
    return frame(spark, [(f"e{i}",) for i in range(n)], "node string"), frame(spark, calls, "caller string, callee string, case_label string")


def _counted(spark, kept):
    from tesserine.checkpoints import cut

    def count(df):
        kept.append((done := cut(df)).count())
        return done

    return count


def test_propagation_keeps_no_pairs(spark):
    public, calls = _hub(spark)
    accesses = frame(spark, [(f"c{i}", "G", "m", "READ", None, "B1") for i in range(60)], "node string, target string, member string, access_type string, context string, branch_id string")
    constants = frame(spark, [("hub", f"c{i}", 0, str(i % 3)) for i in range(0, 60, 20)], "caller string, callee string, position int, value string")
    parameters = frame(spark, [(f"c{i}", 0, "p") for i in range(60)], "function_id string, position int, name string")
    branches = frame(spark, [(f"c{i}", "B1", "p", "==", "1", False, "x") for i in range(60)], "callee string, branch_id string, param string, op string, value string, is_else boolean, chain string")
    kept = []
    got = dataflow.propagate(public, calls, accesses, constants, parameters, branches, cut=_counted(spark, kept)).collect()
    assert {tuple(r) for r in got} == {(f"e{i}", "G", "m", "READ", "c1", 2) for i in range(60)}
    assert max(kept) < 200  # 60 x 60 pairs are 3,600


def test_register_propagation_keeps_no_pairs(spark):
    public, calls = _hub(spark)
    registers = frame(spark, [(f"c{i}", "R", "READ", f"F{i}") for i in range(60)], "node string, register string, access_type string, field string")
    kept = []
    got = dataflow.propagate_registers(public, calls, registers, cut=_counted(spark, kept)).collect()
    assert {tuple(r) for r in got} == {(f"e{i}", "R", "READ", "F0", True) for i in range(60)}
    assert max(kept) < 200  # 60 x 60 pairs are 3,600
