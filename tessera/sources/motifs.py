"""Readers of the result files of motif search tools, each file as one text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOTIFS_DDL = "path string, motif_num int, width int, num_sites int, llr double, evalue double, pssm array<array<double>>, sites array<struct<name string, reverse boolean, start int, pvalue double, left string, seq string, right string>>"
_HEAD = re.compile(r"^MOTIF\s+(?:\S+\s+MEME-(\d+)|(\d+))\s+width =\s*(\d+)\s+sites =\s*(\d+)\s+llr =\s*(\S+)\s+E-value =\s*(\S+)", re.M)
_SITE = re.compile(r"^(\S+)\s+(?:([+-])\s+)?(\d+)\s+(\d\S*)\s+([A-Z.]+(?:\s+[A-Z.]+){0,2})\s*$")


def _flanked(parts: list[str], start: int, width: int) -> list[str]:
    """Left flank, site and right flank; a site at an end of its sequence has but one."""
    if len(parts) == 3:
        return parts
    if len(parts) == 1:
        return ["", parts[0], ""]
    left_gone = start == 1 or (len(parts[0]) == width and len(parts[1]) != width)
    return ["", *parts] if left_gone else [*parts, ""]


def meme(text: str) -> list[dict]:
    """Motifs of a MEME text, of versions that number them and of those that name them."""
    found = []
    heads = list(_HEAD.finditer(text))
    for m, after in zip(heads, [*heads[1:], None], strict=True):
        part = text[m.start() : after.start() if after else len(text)]
        sites = []
        block = re.search(r"sites sorted by position p-value\n-+\n(.*?)\n-{20,}\n", part, re.S)
        for line in block[1].split("\n") if block else []:
            s = _SITE.match(line)
            if s and not line.startswith(("Sequence name", "---")):
                left, seq, right = _flanked(s[5].split(), int(s[3]), int(m[3]))
                sites.append({"name": s[1], "reverse": s[2] == "-", "start": int(s[3]), "pvalue": float(s[4]), "left": left.replace(".", ""), "seq": seq, "right": right.replace(".", "")})
        matrix = re.search(r"^letter-probability matrix:[^\n]*w=\s*(\d+)[^\n]*\n((?:\s*[\d.]+\s+[\d.]+\s+[\d.]+\s+[\d.]+\s*\n)+)", part, re.M)
        rows = [[float(x) for x in r.split()] for r in matrix[2].strip().split("\n")] if matrix else []
        found.append({"motif_num": int(m[1] or m[2]), "width": int(m[3]), "num_sites": int(m[4]), "llr": float(m[5]), "evalue": float(m[6]), "pssm": rows, "sites": sites})
    return found


HITS_DDL = "path string, gene string, pvalue double, evalue double, hit_pvalue double, position int, motif_num int"


def mast_xml(text: str) -> list[dict]:
    """One row a hit of every sequence (one without hits has none): strand as the motif's sign, positions two on."""
    root = ET.fromstring(text)
    ids = {m.get("id"): i + 1 for i, m in enumerate(root.iter("motif"))}
    out = []
    for seq in root.iter("sequence"):
        score = seq.find("score")
        own = {"gene": seq.get("name"), "pvalue": float(score.get("combined_pvalue")), "evalue": float(score.get("evalue"))}
        hits = list(seq.iter("hit"))
        for h in hits:
            name = h.get("motif") if h.get("motif") is not None else h.get("idx")
            num = ids.get(name) or (int(re.sub(r"\D", "", name)) if h.get("motif") is not None else int(name) + 1)
            forward = h.get("strand", "forward") == "forward" and h.get("rc", "n") != "y"
            out.append({**own, "hit_pvalue": float(h.get("pvalue")), "position": int(h.get("pos")) + 2, "motif_num": num if forward else -num})
        if not hits:
            out.append({**own, "hit_pvalue": None, "position": None, "motif_num": None})
    return out


_LENGTH = re.compile(r"LENGTH = \d+\s+COMBINED P-VALUE =\s*(\S+)\s+E-VALUE =\s*(\S+)")
_NAMED, _OFFSET = re.compile(r"\[([+-]?)(\d+)\]|<([+-]?)(\d+)>"), re.compile(r"^(\d+)\s+\S+\s*$")


def mast_text(text: str) -> list[dict]:
    """Hits of the annotated sequences of a MAST 4.3 text: blocks of five lines of 80 columns under each name."""
    section = text.find("SECTION III")
    lines = text[max(section, 0) :].split("\n")
    heads = [(i, m) for i, line in enumerate(lines) if "LENGTH = " in line and (m := _LENGTH.search(line))]
    out = []
    for (i, m), (end, _) in zip(heads, [*heads[1:], (len(lines), None)], strict=True):
        j = i - 1
        while j > 0 and (not lines[j].strip() or lines[j].startswith(" ")):
            j -= 1
        gene, own = lines[j].split()[0], {"pvalue": float(m[1]), "evalue": float(m[2])}
        hits: list[dict] = []
        i += 1
        while i < min(end, len(lines) - 4):
            names = list(_NAMED.finditer(lines[i])) if "[" in lines[i] or "<" in lines[i] else []
            if names and (at := _OFFSET.match(lines[i + 4])):
                offset, margin = int(at[1]), len(lines[i + 4]) - len(lines[i + 4].lstrip("0123456789 "))
                values = lines[i + 1]
                for n in names:
                    p = re.search(r"\S+", values[n.start() :])
                    sign = -1 if (n[1] or n[3]) == "-" else 1
                    hits.append({"hit_pvalue": float(p[0]), "position": offset + n.start() - margin, "motif_num": sign * int(n[2] or n[4])})
                i += 5
            else:
                i += 1
        out += [{"gene": gene, **own, **h} for h in hits] or [{"gene": gene, **own, "hit_pvalue": None, "position": None, "motif_num": None}]
    return out


WEEDER_DDL = "path string, motif_num int, name string, highest boolean, pssm array<array<double>>, sites array<struct<name string, reverse boolean, seq string, start int, match double>>"


def weeder(text: str, column: int = 0) -> list[dict]:
    """Motifs of a Weeder text; the matrix is of all occurrences (0) or of the best ones (1), rows summing to one."""
    names = {int(n): s for n, s in re.findall(r"^Sequence (\d+) : >(\S+)", text, re.M)}
    end = text.find("*** Interesting motifs (not highest-ranking)")
    out = []
    for m in re.finditer(r"^([ACGT]{6,})\s*\n(?:[ACGT]{6,}\s*\n)?\s*\n\d+ redundant motifs found:.*?^Best occurrences:\s*\n[^\n]*\n(.*?)\n\s*\n.*?Frequency Matrix[^\n]*\n[^\n]*\n[^\n]*\n(.*?)\n\s*\n?=+", text, re.M | re.S):
        sites = []
        for s in re.finditer(r"^\s*(\d+)\s+([+-])\s+\[?\s*([ACGT]+)\]?\s+(\d+)\s+\(([\d.]+)\)", m[2], re.M):
            sites.append({"name": names.get(int(s[1]), s[1]), "reverse": s[2] == "-", "seq": s[3], "start": int(s[4]), "match": float(s[5])})
        rows = []
        for line in m[3].strip().split("\n"):
            x = [float(v) for v in line.split()[1:]]
            if len(x) == 8:
                x = x[4 * column : 4 * column + 4]
                rows.append([v / sum(x) for v in x] if sum(x) else x)
        out.append({"motif_num": len(out) + 1, "name": m[1], "highest": end < 0 or m.start() < end, "pssm": rows, "sites": sites})
    return out


PSSM_DDL = "path string, name string, pssm array<array<double>>"


def pssm(text: str) -> list[dict]:
    """Records of a name and four lines for A, C, G and T, a value for each position."""
    out = []
    for record in text.split(">")[1:]:
        name, *rest = [x for x in record.strip().split("\n") if x.strip()]
        columns = [[float(v) for v in line.split()] for line in rest[:4]]
        out.append({"name": name.split()[0], "pssm": [list(r) for r in zip(*columns, strict=True)]})
    return out


def read(spark: SparkSession, path: str, parse: Callable[[str], list[dict]], ddl: str) -> DataFrame:
    """Files that fit into memory one by one, parsed each by a task."""

    def run(batches):
        for p in batches:
            for where, text in zip(p["path"], p["value"], strict=True):
                found = parse(text)
                if found:
                    yield pd.DataFrame(found).assign(path=where)[[x.strip().split(" ")[0] for x in _top_level(ddl)]]

    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).mapInPandas(run, ddl)


def _top_level(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]
