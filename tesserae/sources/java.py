"""Java sources to facts: files are parsed one by one, symbols are resolved by joins over the whole batch.

The parser is a tokenizer and a reader of declarations and statements, not a compiler: it knows classes, supertypes,
annotations, fields, methods, calls and loops. What a name means is found by joins: its imports, its package, the types
around it, and what the batch declares. A resolved symbol has fidelity L2_SYMBOL_RESOLVED, a name as written L1_SYNTAX.

Limits, all visible through fidelity: receivers are typed by fields, parameters, this and type names only; overloads by the
number of arguments; calls on other expressions stay names. Constructor calls are no calls. Locals give no dependency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import EVIDENCE
from tesserae.sources.facts import Extraction, ExtractionRequest
from tesserae.storage import stored

# Primitive types, keywords that no call begins with, annotations and marker interfaces.
PRIMITIVES = ("boolean", "byte", "short", "int", "long", "char", "float", "double", "void", "var")
KEYWORDS = frozenset("if else for while do switch case default try catch finally synchronized return throw new assert super this yield instanceof".split())
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
STEREOTYPES = {
    "org.springframework.stereotype.Controller": "spring",
    "org.springframework.stereotype.Service": "spring",
    "org.springframework.stereotype.Repository": "spring-data",
}
MARKERS = (
    "org.springframework.data.repository.Repository",
    "org.springframework.data.repository.CrudRepository",
    "org.springframework.data.repository.PagingAndSortingRepository",
    "org.springframework.data.repository.ListCrudRepository",
    "org.springframework.data.repository.ListPagingAndSortingRepository",
    "org.springframework.data.repository.reactive.ReactiveCrudRepository",
    "org.springframework.data.repository.reactive.ReactiveSortingRepository",
    "org.springframework.data.jpa.repository.JpaRepository",
)
JAVA_LANG = tuple("Object String Integer Long Short Byte Character Boolean Double Float Number Math Iterable Comparable Runnable Thread Throwable Exception RuntimeException Error Enum Record Class System StringBuilder CharSequence Override Deprecated AutoCloseable Cloneable".split())

_TOKEN = re.compile(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?\*/|[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\d[\w.]*|->|::|\.\.\.|[^\s]')
_NAME = re.compile(r"[A-Za-z_$\u0080-￿]")


class Source:
    """One file's declarations as rows (kind, owner, name, type, args, depth)."""

    def __init__(self, text: str) -> None:
        self.t = [x for x in _TOKEN.findall(text) if not x.startswith(("//", "/*"))] + ["", "", ""]
        self.rows: list[tuple] = []
        self.package = ""
        i = 0
        while self.t[i]:
            if self.t[i] == "package":
                self.package, i = self.dotted(i + 1)
            elif self.t[i] == "import":
                static = self.t[i + 1] == "static"
                name, i = self.dotted(i + 1 + static)
                if not static:
                    self.rows.append(("import", "", name.rpartition(".")[2], name, [], 0))
            elif (j := self.declaration(i, "")) is not None:
                i = j
            else:
                i += 1

    def dotted(self, i: int) -> tuple[str, int]:
        parts = []
        while _NAME.match(self.t[i]) or self.t[i] == "*":
            parts.append(self.t[i])
            i += 1
            if self.t[i] != ".":
                break
            i += 1
        return ".".join(parts), i

    def match(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        depth = 0
        while self.t[i]:
            depth += (self.t[i] in "([{") - (self.t[i] in ")]}")
            if depth == 0:
                return i
            i += 1
        return i

    def generics(self, i: int) -> int:
        """Past <...> at i, if there is one."""
        if self.t[i] != "<":
            return i
        depth = 0
        while self.t[i]:
            depth += (self.t[i] == "<") - (self.t[i] == ">")
            i += 1
            if depth == 0:
                break
        return i

    def type(self, i: int) -> tuple[str, int]:
        """A type as written, without type arguments, with [] for arrays."""
        name, i = self.dotted(i)
        i = self.generics(i)
        while self.t[i] == "." and _NAME.match(self.t[i + 1]):
            more, i = self.dotted(i + 1)
            name, i = f"{name}.{more}", self.generics(i)
        while self.t[i] == "[" and self.t[i + 1] == "]":
            name, i = name + "[]", i + 2
        if self.t[i] == "...":
            name, i = name + "[]", i + 1
        return name, i

    def prefix(self, i: int) -> tuple[list[str], int]:
        """Annotations, and past modifiers."""
        found = []
        while True:
            if self.t[i] == "@" and self.t[i + 1] != "interface":
                name, i = self.dotted(i + 1)
                found.append(name)
                if self.t[i] == "(":
                    i = self.match(i) + 1
            elif self.t[i] == "non" and self.t[i + 1] == "-":
                i += 3
            elif self.t[i] in MODIFIERS:
                i += 1
            else:
                return found, i

    def declaration(self, i: int, outer: str) -> int | None:
        """A class, interface, enum, record or annotation at i, and the place after it; None if there is none."""
        notes, j = self.prefix(i)
        if self.t[j] == "@" and self.t[j + 1] == "interface":
            j += 1
        kind = self.t[j]
        if kind not in ("class", "interface", "enum", "record") or not _NAME.match(self.t[j + 1]) or (kind == "record" and self.t[j + 2] not in ("(", "<")):
            return None
        owner = outer + "$" + self.t[j + 1] if outer else (self.package + "." if self.package else "") + self.t[j + 1]
        self.rows.append(("class", owner, kind, "", notes, 0))
        j = self.generics(j + 2)
        if kind == "record":
            self.parameters(owner, j, True)
            j = self.match(j) + 1
        while self.t[j] and self.t[j] != "{":
            what, j = self.t[j], j + 1
            while what in ("extends", "implements", "permits") and self.t[j] and self.t[j] != "{":
                _, j = self.prefix(j)
                name, j = self.type(j)
                if what != "permits":
                    # an interface's supertypes count as implemented
                    self.rows.append(("super", owner, "IMPLEMENTS" if what == "implements" or kind == "interface" else "EXTENDS", name, [], 0))
                if self.t[j] != ",":
                    break
                j += 1
        return self.body(owner, j + 1, kind == "enum")

    def parameters(self, owner: str, i: int, fields: bool = False) -> tuple[list[str], dict[str, str]]:
        types, names = [], {}
        end, i = self.match(i), i + 1
        while i < end:
            _, i = self.prefix(i)
            kind, j = self.type(i)
            if j == i:
                break
            types.append(kind)
            if _NAME.match(self.t[j]):
                names[self.t[j]] = kind
                if fields:
                    self.rows.append(("field", owner, self.t[j], kind, [], 0))
            while j < end and self.t[j] != ",":
                j += 1
            i = j + 1
        return types, names

    def body(self, owner: str, i: int, enum: bool) -> int:
        if enum:  # past the constants
            while self.t[i] and self.t[i] not in ";}":
                i = self.match(i) + 1 if self.t[i] in "({" else i + 1
        while self.t[i] and self.t[i] != "}":
            if self.t[i] == ";":
                i += 1
                continue
            if (j := self.declaration(i, owner)) is not None:
                i = j
                continue
            _, j = self.prefix(i)
            if self.t[j] == "{":
                i = self.statement(owner, owner, j, 0)
                continue
            j = self.generics(j)
            kind, k = self.type(j)
            if k == j:
                i = j + 1
                continue
            if self.t[k] == "(":  # a constructor has no type before its name
                name, kind = kind, ""
            elif self.t[k + 1] == "(":
                name, k = self.t[k], k + 1
            else:
                i = self.fields(owner, kind, k)
                continue
            types, names = self.parameters(owner, k)
            method = f"{owner}#{name}({','.join(types)})"
            self.rows.append(("method", owner, name, method, types, 0))
            self.rows += [("param", method, n, t, [], 0) for n, t in names.items()]
            k = self.match(k) + 1
            while self.t[k] and self.t[k] not in "{;":
                k += 1
            i = self.statement(owner, method, k, 0) if self.t[k] == "{" else k + 1
        return i + 1

    def fields(self, owner: str, kind: str, i: int) -> int:
        self.rows.append(("field", owner, self.t[i], kind, [], 0))
        start = i
        while self.t[i] and self.t[i] != ";":
            i = self.match(i) + 1 if self.t[i] in "([{" else i + 1
            if self.t[i] == "," and _NAME.match(self.t[i + 1]) and self.t[i + 2] in (",", "=", ";"):
                self.rows.append(("field", owner, self.t[i + 1], kind, [], 0))
        self.calls(owner, owner, start, i, 0)
        return i + 1

    def statement(self, owner: str, method: str, i: int, depth: int) -> int:
        t = self.t[i]
        if t == "{":
            i += 1
            while self.t[i] and self.t[i] != "}":
                i = self.statement(owner, method, i, depth)
            return i + 1
        if t in ("for", "while") and self.t[i + 1] == "(":
            end = self.match(i + 1)
            self.calls(owner, method, i + 2, end, depth + 1)
            return end + 2 if self.t[end + 1] == ";" else self.statement(owner, method, end + 1, depth + 1)
        if t == "do":
            i = self.statement(owner, method, i + 1, depth + 1)
            if self.t[i] == "while":
                end = self.match(i + 1)
                self.calls(owner, method, i + 2, end, depth + 1)
                return end + 2
            return i
        if t in ("if", "catch", "switch", "synchronized") and self.t[i + 1] == "(":
            end = self.match(i + 1)
            self.calls(owner, method, i + 2, end, depth)
            return self.statement(owner, method, end + 1, depth)
        if t == "try" and self.t[i + 1] == "(":
            end = self.match(i + 1)
            self.calls(owner, method, i + 2, end, depth)
            return self.statement(owner, method, end + 1, depth)
        if t in ("else", "try", "finally"):
            return self.statement(owner, method, i + 1, depth)
        if (j := self.declaration(i, owner)) is not None:
            return j
        start, level = i, 0
        while self.t[i]:
            t = self.t[i]
            if t == "{":  # a lambda's, an anonymous class's or an array's
                self.calls(owner, method, start, i, depth)
                start = i = self.statement(owner, method, i, depth)
                continue
            if t == ";" and level <= 0:
                self.calls(owner, method, start, i, depth)
                return i + 1
            if t == "}":
                self.calls(owner, method, start, i, depth)
                return i
            level += (t in "([") - (t in ")]")
            i += 1
        return i

    def calls(self, owner: str, method: str, i: int, end: int, depth: int) -> None:
        """The invocations among the tokens i to end."""
        for k in range(i, end):
            name = self.t[k]
            if self.t[k + 1] != "(" or not _NAME.match(name) or name in KEYWORDS:
                continue
            first = k
            while first >= 2 and self.t[first - 1] == "." and _NAME.match(self.t[first - 2]):
                first -= 2
            if self.t[first - 1] in ("new", "@"):
                continue
            receiver = ".".join(self.t[first : k - 1 : 2]) if first < k else "" if self.t[k - 1] != "." else "?"
            close, args, level = self.match(k + 1), 0, 0
            for x in range(k + 2, close):
                args += self.t[x] == "," and level == 0
                level += (self.t[x] in "([{") - (self.t[x] in ")]}")
            n = 0 if close == k + 2 else args + 1
            self.rows.append(("call", owner, name, receiver, [method, str(n)], depth))


ROWS = "path string, package string, seq int, kind string, owner string, name string, type string, args array<string>, depth int"


def files(spark: SparkSession, roots: tuple[str, ...]) -> DataFrame:
    """(path, content) of every .java file under the roots, in the order of their paths."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(list(roots)).select("path", "content").orderBy("path")


def parsed(sources: DataFrame) -> DataFrame:
    """One row per declaration; a file that can't be read gives a row of kind error."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    s = Source(content.decode())
                    rows += [(path, s.package, i, *r) for i, r in enumerate(s.rows)]
                except (UnicodeDecodeError, RecursionError) as e:
                    rows.append((path, "", 0, "error", "", "", f"{type(e).__name__}: {path}", [], 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names)

    return sources.mapInArrow(run, ROWS)


def resolved(used: DataFrame, rows: DataFrame) -> DataFrame:
    """used(path, package, owner, type, ...) with fqn: NULL where neither imports nor the batch tell what the type is.

    Asked in turn: a name that is declared as it stands, imports, types nested in the owner, the package, imports on
    demand, java.lang. Type arguments are gone already; of an array the element type is asked.
    """
    declared = rows.where("kind = 'class'").select(F.translate("owner", "$", ".").alias("fqn")).distinct()
    imports = rows.where("kind = 'import' and name <> '*'").select("path", F.col("name").alias("simple"), F.col("type").alias("imported")).dropDuplicates(["path", "simple"])
    wide = rows.where("kind = 'import' and name = '*'").select("path", F.expr("left(type, length(type) - 2)").alias("from"))
    u = used.withColumn("plain", F.regexp_replace("type", r"\[\]", "")).withColumn("simple", F.substring_index("plain", ".", 1)).withColumn("uid", F.monotonically_increasing_id())
    u = stored(u, "java")
    rest = F.expr("substring(plain, length(simple) + 1)")
    u2 = u.join(imports, ["path", "simple"], "left")
    owner = F.translate("owner", "$", ".")
    tries = [F.col("plain"), F.concat("imported", rest), F.concat(owner, F.lit("."), "plain"), F.concat(F.regexp_replace(owner, r"\.[^.]*$", ""), F.lit("."), "plain"), F.when(F.col("package") != "", F.concat("package", F.lit("."), "plain"))]
    each = u2.select("uid", F.posexplode(F.array(*tries)).alias("rank", "fqn"))
    each = each.unionByName(u.join(wide, "path").select("uid", F.lit(len(tries)).alias("rank"), F.concat("from", F.lit("."), "plain").alias("fqn")))
    hits = each.where("fqn is not null").join(declared, "fqn").groupBy("uid").agg(F.min(F.struct("rank", "fqn"))["fqn"].alias("hit"))
    lang = F.when(F.col("plain").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), "plain"))
    written = F.when(F.col("plain").rlike(r"^[a-z_]\w*(\.\w+)+$"), F.col("plain"))
    named = u2.select("uid", F.coalesce(F.concat("imported", rest), written, lang).alias("named"))
    return u.join(hits, "uid", "left").join(named, "uid", "left").withColumn("fqn", F.coalesce("hit", "named")).drop("uid", "plain", "simple", "hit", "named")


def _evidence(adapter: Column | str, description: Column, path: Column, level: Column | str, context: Column | str = "UNKNOWN", attributes: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(adapter).alias("source_adapter"), description.alias("description"), path.alias("location"), text(level).alias("fidelity"), text(context).alias("execution_context"), (attributes if attributes is not None else F.create_map().cast("map<string,string>")).alias("attributes"))


L1, L2 = "L1_SYNTAX", "L2_SYMBOL_RESOLVED"


def extract(spark: SparkSession, request: ExtractionRequest, subject_id: str = "subject", scan_id: str = "scan") -> Extraction:
    """Facts of all Java files under the request's roots."""
    rows = stored(parsed(files(spark, request.roots)), "java")
    key = [F.lit(subject_id).alias("subject_id"), F.lit(scan_id).alias("scan_id")]
    empty, none = F.create_map().cast("map<string,string>"), F.array().cast(f"array<{EVIDENCE}>")
    dotted = lambda c: F.translate(c, "$", ".")
    level = lambda c: F.when(c.isNotNull(), L2).otherwise(L1)
    classes = rows.where("kind = 'class'")
    # role evidence of classes, from their annotations and direct supertypes
    notes = resolved(classes.select("path", "package", "owner", F.explode("args").alias("type")), rows)
    adapter = F.lit(None).cast("string")
    for a, b in STEREOTYPES.items():
        adapter = F.when(F.col("fqn") == a, b).otherwise(adapter)
    roles = notes.where(F.col("fqn").isin(*STEREOTYPES)).select("owner", _evidence(adapter, F.concat(F.lit("@"), F.substring_index("fqn", ".", -1), F.lit(" annotation")), F.col("path"), L2, attributes=F.create_map(F.lit("annotation"), "fqn")).alias("e"))
    supers = stored(resolved(rows.where("kind = 'super'").select("path", "package", "owner", "name", "type", "seq"), rows), "java")
    marks = supers.where(F.col("fqn").isin(*MARKERS)).select("owner", _evidence("spring-data", F.concat(F.lit("extends "), "fqn"), F.col("path"), L2, attributes=F.create_map(F.lit("springDataMarkerInterface"), "fqn")).alias("e"))
    by_class = stored(roles.unionByName(marks).groupBy("owner").agg(F.collect_list("e").alias("roles")), "java")
    declared = _evidence("java", F.concat("name", F.lit(" declaration")), F.col("path"), L2)
    types = classes.join(by_class, "owner", "left").select(*key, dotted("owner").alias("id"), F.lit("COMPONENT").alias("type"), empty.alias("attributes"), F.concat(F.array(declared), F.coalesce("roles", none)).alias("evidence"))
    methods = rows.where("kind = 'method'")
    method_id = F.concat(dotted("owner"), F.expr("substring(type, length(owner) + 1)"))
    functions = methods.join(by_class, "owner", "left").select(*key, method_id.alias("id"), F.lit("FUNCTION").alias("type"), empty.alias("attributes"), F.concat(F.array(_evidence("java", F.lit("method declaration"), F.col("path"), L2)), F.coalesce("roles", none)).alias("evidence"))
    edge = lambda df, src, dst, desc, relation, ev: df.select(*key, src.alias("source_key"), src.alias("source_desc"), dst.alias("target_key"), desc.alias("target_desc"), relation.alias("relation"), F.array(ev).alias("provenance"))
    named = lambda: F.coalesce("fqn", "type")
    up = edge(supers, dotted("owner"), named(), named(), F.col("name"), _evidence("java", F.concat("name", F.lit(" "), "type"), F.col("path"), level(F.col("fqn"))))
    fields = stored(resolved(rows.where("kind = 'field'").where(~F.regexp_replace("type", r"\[\]", "").isin(*PRIMITIVES)).select("path", "package", "owner", "name", "type"), rows), "java")
    uses = edge(fields, dotted("owner"), named(), named(), F.lit("DEPENDS"), _evidence("java", F.concat(F.lit("field "), "name"), F.col("path"), level(F.col("fqn"))))
    member = edge(methods, method_id, dotted("owner"), dotted("owner"), F.lit("MEMBER_OF"), _evidence("java", F.concat(F.lit("member "), "name"), F.col("path"), L2))
    # the type of a call's receiver: the owner itself, a field's, a parameter's, or a type's name
    calls = rows.where("kind = 'call'").select("path", "package", "owner", "name", F.regexp_replace("type", r"^this\.", "").alias("receiver"), F.get("args", F.lit(0)).alias("method"), F.get("args", F.lit(1)).cast("int").alias("n"), "depth", "seq")
    f = fields.select("owner", F.col("name").alias("receiver"), F.col("fqn").alias("field_type")).dropDuplicates(["owner", "receiver"])
    params = resolved(rows.where("kind = 'param'").select("path", "package", F.substring_index("owner", "#", 1).alias("owner"), F.col("owner").alias("method"), "name", "type"), rows)
    p = params.select("method", F.col("name").alias("receiver"), F.col("fqn").alias("param_type")).dropDuplicates(["method", "receiver"])
    t = resolved(calls.where("receiver rlike '^[A-Z]'").select("path", "package", "owner", F.col("receiver").alias("type")).distinct(), rows).select("path", "owner", F.col("type").alias("receiver"), F.col("fqn").alias("named_type"))
    calls = calls.join(f, ["owner", "receiver"], "left").join(p, ["method", "receiver"], "left").join(t, ["path", "owner", "receiver"], "left")
    target = F.when(F.col("receiver").isin("", "this"), dotted("owner")).otherwise(F.coalesce("param_type", "field_type", "named_type"))
    known = methods.select(dotted("owner").alias("target"), "name", F.size("args").alias("n"), method_id.alias("callee")).groupBy("target", "name", "n").agg(F.min("callee").alias("callee"), F.count("*").alias("same")).where("same = 1").drop("same")
    calls = calls.withColumn("target", target).join(known, ["target", "name", "n"], "left")
    source = F.concat(dotted("owner"), F.expr("substring(method, length(owner) + 1)"))
    context = F.when(F.col("depth") > 0, "ITERATED").otherwise("UNKNOWN")
    invoked = edge(calls, source, F.coalesce("callee", "name"), F.coalesce("callee", "name"), F.lit("CALL"), _evidence("java", F.concat(F.lit("call of "), "name"), F.col("path"), level(F.col("callee")), context))
    diagnostics = rows.where("kind = 'error'").select(F.col("type").alias("diagnostic"))
    edges = up.unionByName(uses).unionByName(member).unionByName(invoked)
    return Extraction(stored(types.unionByName(functions), "java"), stored(edges, "java"), diagnostics)
