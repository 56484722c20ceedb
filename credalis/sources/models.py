"""Model files: BIF, XMLBIF, UAI, NET, XBN, PomdpX and a Parquet layout. Parsed on the driver into one neutral form."""

from __future__ import annotations

import itertools
import math
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from credalis.operators.factors import CPD, VALUE, Factor
from credalis.operators.markov import MarkovNetwork
from credalis.operators.network import BayesianNetwork


@dataclass
class Spec:
    """``tables``: variable -> (parents, array with a row for each state and a column for each parent configuration, last parent
    fastest). ``factors``: (scope, array) of an undirected model."""

    name: str = "unknown"
    states: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, tuple[list[str], np.ndarray]] = field(default_factory=dict)
    factors: list[tuple[list[str], np.ndarray]] = field(default_factory=list)
    properties: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, net: BayesianNetwork | MarkovNetwork, name: str = "unknown") -> Spec:
        if isinstance(net, MarkovNetwork):
            return cls(name, {v: list(map(str, s)) for v, s in net.states.items()}, factors=[(f.variables, f.values()) for f in net.factors])
        return cls(name, {v: list(map(str, net.cpds[v].states[v])) for v in net.nodes}, {v: (c.parents, c.rows()) for v, c in net.cpds.items()})

    def network(self, spark: SparkSession) -> BayesianNetwork:
        net = BayesianNetwork([(p, v) for v, (ps, _) in self.tables.items() for p in ps], self.states)
        return net.add_cpds(*[CPD.table(spark, v, rows, ps, {n: self.states[n] for n in (v, *ps)}) for v, (ps, rows) in self.tables.items()])

    def markov(self, spark: SparkSession) -> MarkovNetwork:
        return MarkovNetwork([Factor.of(spark, scope, values, {v: self.states[v] for v in scope}) for scope, values in self.factors])

    def shape(self, v: str) -> tuple[int, int]:
        return len(self.states[v]), math.prod(len(self.states[p]) for p in self.tables[v][0])

    def configs(self, v: str) -> list[tuple[str, ...]]:
        return list(itertools.product(*(self.states[p] for p in self.tables[v][0])))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.findall(_NUMBER, text)]


def _bare(text: str) -> str:
    return re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)


# --- BIF ----------------------------------------------------------------------------------------------------------


def read_bif(text: str) -> Spec:
    text = _bare(text)
    out = Spec(m[1].strip('"') if (m := re.search(r'network\s+("[^"]*"|\S+)\s*\{', text)) else "unknown")
    for m in re.finditer(r'variable\s+("[^"]*"|[^\s{]+)\s*\{(.*?\}\s*;.*?)\}', text, re.S):
        states = re.search(r"\{(.*?)\}", m[2], re.S)[1]
        v = m[1].strip('"')
        out.states[v] = [s.strip().strip('"') for s in states.split(",") if s.strip()]
        out.properties[v] = dict(p.split("=", 1) if "=" in p else (p, "") for p in (x.strip().strip('"') for x in re.findall(r"property\s+(.*?);", m[2], re.S)))
    for m in re.finditer(r"probability\s*\((.*?)\)\s*\{(.*?)\}", text, re.S):
        left, _, right = m[1].partition("|")
        v = left.strip().strip('"')
        parents = [p.strip().strip('"') for p in right.split(",") if p.strip()]
        out.tables[v] = (parents, np.zeros((0, 0)))
        card, n = out.shape(v)
        rows = np.full((card, n), np.nan)
        if t := re.search(r"table\s+(.*?);", m[2], re.S):
            rows = np.array(_numbers(t[1])).reshape(card, n)
        if t := re.search(r"default\s+(.*?);", m[2], re.S):
            rows[:] = np.array(_numbers(t[1])).reshape(card, 1)
        place = {c: i for i, c in enumerate(out.configs(v))}
        for r in re.finditer(r"\(([^()]*)\)\s*([^;]*);", m[2]):
            rows[:, place[tuple(s.strip().strip('"') for s in r[1].split(","))]] = _numbers(r[2])
        out.tables[v] = (parents, rows)
    return out


def write_bif(spec: Spec, digits: int | None = None) -> str:
    show = lambda x: repr(round(float(x), digits) if digits is not None else float(x))
    out = [f"network {spec.name} {{\n}}\n"]
    for v in sorted(spec.states):
        out.append(f"variable {v} {{\n    type discrete [ {len(spec.states[v])} ] {{ {', '.join(spec.states[v])} }};\n" + "".join(f"    property {k} = {x};\n" if x else f"    property {k};\n" for k, x in spec.properties.get(v, {}).items()) + "}\n")
    for v in sorted(spec.tables):
        parents, rows = spec.tables[v]
        if parents:
            body = "".join(f"    ({', '.join(c)}) {', '.join(map(show, rows[:, i]))};\n" for i, c in enumerate(spec.configs(v)))
            out.append(f"probability ( {v} | {', '.join(parents)} ) {{\n{body}}}\n")
        else:
            out.append(f"probability ( {v} ) {{\n    table {', '.join(map(show, rows[:, 0]))};\n}}\n")
    return "".join(out)


# --- XMLBIF -------------------------------------------------------------------------------------------------------


def read_xmlbif(text: str) -> Spec:
    root = ET.fromstring(text.strip())
    net = root if root.tag == "NETWORK" else root.find("NETWORK")
    out = Spec(net.findtext("NAME", "unknown"))
    for x in net.iter("VARIABLE"):
        v = x.findtext("NAME").strip()
        out.states[v] = [o.text.strip() for o in x.iter("OUTCOME")]
        out.properties[v] = dict((p.text or "").split("=", 1) if "=" in (p.text or "") else ((p.text or "").strip(), "") for p in x.iter("PROPERTY"))
    for x in net.iter("DEFINITION"):
        v = x.findtext("FOR").strip()
        out.tables[v] = ([g.text.strip() for g in x.iter("GIVEN")], np.zeros((0, 0)))
        card, n = out.shape(v)
        out.tables[v] = (out.tables[v][0], np.array(_numbers(re.sub(r"<!--.*?-->", "", x.findtext("TABLE")))).reshape(n, card).T)
    return out


def write_xmlbif(spec: Spec) -> str:
    root = ET.Element("BIF", VERSION="0.3")
    net = ET.SubElement(root, "NETWORK")
    ET.SubElement(net, "NAME").text = spec.name
    for v in sorted(spec.states):
        x = ET.SubElement(net, "VARIABLE", TYPE="nature")
        ET.SubElement(x, "NAME").text = v
        for s in spec.states[v]:
            ET.SubElement(x, "OUTCOME").text = s
        for k, p in spec.properties.get(v, {}).items():
            ET.SubElement(x, "PROPERTY").text = f"{k}={p}" if p else k
    for v in sorted(spec.tables):
        parents, rows = spec.tables[v]
        x = ET.SubElement(net, "DEFINITION")
        ET.SubElement(x, "FOR").text = v
        for p in parents:
            ET.SubElement(x, "GIVEN").text = p
        ET.SubElement(x, "TABLE").text = " ".join(repr(float(p)) for p in rows.T.ravel())
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


# --- UAI ----------------------------------------------------------------------------------------------------------


def read_uai(text: str) -> Spec:
    """Variables are ``var_0``, ``var_1`` ...; tables of a BAYES file list the child last."""
    words = iter(text.split())
    kind = next(words).upper()
    n = int(next(words))
    cards = [int(next(words)) for _ in range(n)]
    out = Spec(kind, {f"var_{i}": [str(s) for s in range(c)] for i, c in enumerate(cards)})
    scopes = [[int(next(words)) for _ in range(int(next(words)))] for _ in range(int(next(words)))]
    for scope in scopes:
        values = np.array([float(next(words)) for _ in range(int(next(words)))]).reshape([cards[i] for i in scope])
        names = [f"var_{i}" for i in scope]
        if kind == "BAYES":
            out.tables[names[-1]] = (names[:-1], values.reshape(-1, cards[scope[-1]]).T)
        else:
            out.factors.append((names, values))
    return out


def write_uai(spec: Spec) -> str:
    names = list(spec.states) if all(re.fullmatch(r"var_\d+", v) for v in spec.states) else sorted(spec.states)
    names.sort(key=lambda v: int(v[4:]) if re.fullmatch(r"var_\d+", v) else 0)
    at = {v: i for i, v in enumerate(names)}
    items = spec.factors or [([*ps, v], rows.T) for v, (ps, rows) in sorted(spec.tables.items(), key=lambda x: at[x[0]])]
    show = lambda a: " ".join(repr(float(x)) for x in np.asarray(a).ravel())
    head = ["MARKOV" if spec.factors else "BAYES", str(len(names)), " ".join(str(len(spec.states[v])) for v in names), str(len(items))]
    return "\n".join(head + [f"{len(s)} " + " ".join(str(at[v]) for v in s) for s, _ in items] + [f"\n{np.asarray(a).size}\n{show(a)}" for _, a in items]) + "\n"


# --- NET ----------------------------------------------------------------------------------------------------------


def read_net(text: str) -> Spec:
    text = re.sub(r"%[^\n]*", "", text)
    out = Spec()
    for m in re.finditer(r"\bnode\s+(\S+)\s*\{(.*?)\}", text, re.S):
        out.states[m[1]] = re.findall(r'"([^"]*)"', re.search(r"states\s*=\s*\((.*?)\)", m[2], re.S)[1])
        out.properties[m[1]] = {k: x.strip() for k, x in re.findall(r"(\w+)\s*=\s*([^;]*);", m[2]) if k != "states"}
    for m in re.finditer(r"potential\s*\((.*?)\)\s*\{(.*?)\}", text, re.S):
        left, _, right = m[1].partition("|")
        v, parents = left.strip(), right.split()
        out.tables[v] = (parents, np.zeros((0, 0)))
        card, n = out.shape(v)
        data = re.search(r"data\s*=\s*(.*?);", m[2], re.S)
        rows = np.array(_numbers(data[1])).reshape(n, card).T if data else np.full((card, n), 1 / card)
        out.tables[v] = (parents, rows)
    return out


def write_net(spec: Spec) -> str:
    out = ["net\n{\n}\n"]
    for v in sorted(spec.states):
        out.append(f"node {v}\n{{\n    states = ( {' '.join(chr(34) + s + chr(34) for s in spec.states[v])} );\n" + "".join(f"    {k} = {x};\n" for k, x in spec.properties.get(v, {}).items() if x) + "}\n")
    for v in sorted(spec.tables):
        parents, rows = spec.tables[v]
        shape = [len(spec.states[p]) for p in parents]

        def nest(a: np.ndarray) -> str:
            return "(" + " ".join(repr(float(x)) for x in a) + ")" if a.ndim == 1 else "(" + "".join(map(nest, a)) + ")"

        out.append(f"potential ( {v}{' | ' if parents else ''}{' '.join(parents)} )\n{{\n    data = {nest(rows.T.reshape([*shape, len(rows)]))};\n}}\n")
    return "".join(out)


# --- XBN ----------------------------------------------------------------------------------------------------------


def read_xbn(text: str) -> Spec:
    root = ET.fromstring(text.strip())
    model = next(root.iter("BNMODEL"))
    out = Spec(model.get("NAME", "unknown"))
    for x in model.iter("VAR"):
        out.states[x.get("NAME")] = [s.text.strip() for s in x.iter("STATENAME")]
        out.properties[x.get("NAME")] = {k: p for k, p in (("TYPE", x.get("TYPE")), ("XPOS", x.get("XPOS")), ("YPOS", x.get("YPOS")), ("DESCRIPTION", x.findtext("DESCRIPTION"))) if p}
    for x in model.iter("DIST"):
        v = next(x.iter("PRIVATE")).get("NAME")
        out.tables[v] = ([e.get("NAME") for e in x.iter("CONDELEM")], np.zeros((0, 0)))
        card, n = out.shape(v)
        rows = np.zeros((card, n))
        cards = [len(out.states[p]) for p in out.tables[v][0]]
        for k, d in enumerate(x.iter("DPI")):
            at = [int(i) for i in (d.get("INDEXES") or "").split()]
            rows[:, int(np.ravel_multi_index(at, cards)) if at else k] = _numbers(d.text)
        out.tables[v] = (out.tables[v][0], rows)
    return out


def write_xbn(spec: Spec) -> str:
    root = ET.Element("ANALYSISNOTEBOOK", NAME="Notebook", ROOT=spec.name)
    model = ET.SubElement(root, "BNMODEL", NAME=spec.name)
    variables, structure, dists = (ET.SubElement(model, t) for t in ("VARIABLES", "STRUCTURE", "DISTRIBUTIONS"))
    for v in sorted(spec.states):
        p = spec.properties.get(v, {})
        x = ET.SubElement(variables, "VAR", NAME=v, TYPE=p.get("TYPE", "discrete"), XPOS=p.get("XPOS", "0"), YPOS=p.get("YPOS", "0"))
        ET.SubElement(x, "DESCRIPTION").text = p.get("DESCRIPTION", "")
        for s in spec.states[v]:
            ET.SubElement(x, "STATENAME").text = s
    for v in sorted(spec.tables):
        parents, rows = spec.tables[v]
        for p in parents:
            ET.SubElement(structure, "ARC", PARENT=p, CHILD=v)
        x = ET.SubElement(dists, "DIST", TYPE="discrete")
        if parents:
            cond = ET.SubElement(x, "CONDSET")
            for p in parents:
                ET.SubElement(cond, "CONDELEM", NAME=p)
        ET.SubElement(x, "PRIVATE", NAME=v)
        dpis = ET.SubElement(x, "DPIS")
        for k, at in enumerate(itertools.product(*(range(len(spec.states[p])) for p in parents))):
            ET.SubElement(dpis, "DPI", **({"INDEXES": " ".join(map(str, at))} if parents else {})).text = " ".join(repr(float(p)) for p in rows[:, k])
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


# --- PomdpX -------------------------------------------------------------------------------------------------------


def read_pomdpx(text: str) -> dict:
    """A decision process as plain values: description, discount, variables, and the functions with their rows (or diagrams)."""
    root = ET.fromstring(text.strip())
    words = lambda e, t: (e.findtext(t) or "").split()
    out: dict = {"description": root.findtext("Description", "").strip(), "discount": float(root.findtext("Discount", "1")), "variables": {}, "functions": {}}
    for kind in ("StateVar", "ObsVar", "ActionVar", "RewardVar"):
        out["variables"][kind] = []
        for x in root.iter(kind):
            values = words(x, "ValueEnum") or [f"s{i}" for i in range(int(x.findtext("NumValues") or 0))]
            out["variables"][kind].append({k: x.get(k) for k in ("vnamePrev", "vnameCurr", "vname", "fullyObs") if x.get(k) is not None} | {"values": values})
    for kind, item in (("InitialStateBelief", "CondProb"), ("StateTransitionFunction", "CondProb"), ("ObsFunction", "CondProb"), ("RewardFunction", "Func")):
        out["functions"][kind] = []
        for top in root.iter(kind):
            for x in top.iter(item):
                p = x.find("Parameter")
                entry = {"var": words(x, "Var"), "parent": words(x, "Parent"), "type": p.get("type", "TBL") if p is not None else "TBL"}
                if entry["type"] == "DD":
                    entry["diagram"] = _diagram(p.find("DAG"))
                else:
                    entry["rows"] = [{"instance": words(e, "Instance"), "value": (e.findtext("ProbTable") or e.findtext("ValueTable") or "").split()} for e in (p.iter("Entry") if p is not None else ())]
                out["functions"][kind].append(entry)
    return out


def _diagram(x: ET.Element) -> object:
    node = x.find("Node")
    if node is None:
        return (x.findtext("Terminal") or x.findtext("SubDAG") or "").strip() or {k: v for s in x.iter("SubDAG") for k, v in s.attrib.items()}
    return {"var": node.get("var"), "edges": {e.get("val"): _diagram(e) for e in node.findall("Edge")}}


def write_pomdpx(model: dict) -> str:
    root = ET.Element("pomdpx", version="1.0")
    ET.SubElement(root, "Description").text = model["description"]
    ET.SubElement(root, "Discount").text = repr(model["discount"])
    top = ET.SubElement(root, "Variable")
    for kind, items in model["variables"].items():
        for v in items:
            x = ET.SubElement(top, kind, **{k: y for k, y in v.items() if k != "values"})
            if v["values"]:
                ET.SubElement(x, "ValueEnum").text = " ".join(v["values"])
    for kind, items in model["functions"].items():
        if not items:
            continue
        box = ET.SubElement(root, kind)
        reward = kind == "RewardFunction"
        for f in items:
            x = ET.SubElement(box, "Func" if reward else "CondProb")
            ET.SubElement(x, "Var").text = " ".join(f["var"])
            ET.SubElement(x, "Parent").text = " ".join(f["parent"])
            p = ET.SubElement(x, "Parameter", type=f["type"])
            if f["type"] == "DD":
                _draw(ET.SubElement(p, "DAG"), f["diagram"])
            for r in f.get("rows", ()):
                e = ET.SubElement(p, "Entry")
                ET.SubElement(e, "Instance").text = " ".join(r["instance"])
                ET.SubElement(e, "ValueTable" if reward else "ProbTable").text = " ".join(r["value"])
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def _draw(x: ET.Element, diagram: object) -> None:
    if not isinstance(diagram, dict):
        ET.SubElement(x, "Terminal").text = str(diagram)
    elif "edges" in diagram:
        node = ET.SubElement(x, "Node", var=diagram["var"])
        for val, rest in diagram["edges"].items():
            _draw(ET.SubElement(node, "Edge", val=val), rest)
    else:
        ET.SubElement(x, "SubDAG", **diagram)


def pomdpx_rows(spark: SparkSession, model: dict) -> DataFrame:
    """The tables of a decision process: ``(function, var, parents, instance, value)``."""
    rows = [(k, " ".join(f["var"]), f["parent"], r["instance"], r["value"]) for k, fs in model["functions"].items() for f in fs for r in f.get("rows", ())]
    return spark.createDataFrame(rows, "function string, var string, parents array<string>, instance array<string>, value array<string>")


# --- by extension, and Parquet --------------------------------------------------------------------------------------

READERS = {"bif": read_bif, "xmlbif": read_xmlbif, "xml": read_xmlbif, "uai": read_uai, "net": read_net, "xbn": read_xbn}
WRITERS = {"bif": write_bif, "xmlbif": write_xmlbif, "xml": write_xmlbif, "uai": write_uai, "net": write_net, "xbn": write_xbn}


def load(spark: SparkSession, path: str, kind: str | None = None) -> BayesianNetwork | MarkovNetwork:
    """A model by its file's extension; ``parquet`` folders are read by Spark, other files by any path Spark can read."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return load_parquet(spark, path)
    text = spark.read.text(path, wholetext=True).first()[0]
    spec = READERS[kind](text)
    return spec.markov(spark) if spec.factors else spec.network(spark)


def save(net: BayesianNetwork | MarkovNetwork, path: str, kind: str | None = None) -> None:
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        save_parquet(net, path)
    else:
        Path(path).write_text(WRITERS[kind](Spec.of(net)))


def save_parquet(net: BayesianNetwork, path: str) -> None:
    """All tables as rows ``(variable, state, parents, configuration, value)``."""
    rows = [(v, i, s, c.parents, list(map(str, config)), float(c.rows()[i, k])) for v, c in net.cpds.items() for i, s in enumerate(map(str, c.states[v])) for k, config in enumerate(itertools.product(*(c.states[p] for p in c.parents)))]
    spark = next(iter(net.cpds.values())).df.sparkSession
    spark.createDataFrame(rows, f"variable string, number int, state string, parents array<string>, configuration array<string>, {VALUE} double").coalesce(1).write.mode("overwrite").parquet(path)


def load_parquet(spark: SparkSession, path: str) -> BayesianNetwork:
    rows = spark.read.parquet(path).collect()
    spec = Spec()
    for r in sorted(rows, key=lambda r: (r.variable, r.number)):
        own = spec.states.setdefault(r.variable, [])
        if r.state not in own:
            own.append(r.state)
    for v in spec.states:
        own = [r for r in rows if r.variable == v]
        spec.tables[v] = (own[0].parents, np.zeros((0, 0)))
        table = np.zeros(spec.shape(v))
        place = {c: k for k, c in enumerate(spec.configs(v))}
        for r in own:
            table[r.number, place[tuple(r.configuration)]] = r[VALUE]
        spec.tables[v] = (own[0].parents, table)
    return spec.network(spark)


__all__ = ["READERS", "WRITERS", "Spec", "load", "save"]
