from tracewell.operators import parsers as P


def cols(text):
    out = {}
    for d, t, c in P.schema_rows(text):
        out.setdefault((d, t), []).append(c)
    return out


def test_dialects():
    assert cols('CREATE TABLE IF NOT EXISTS "app"."User" (\n id bigint PRIMARY KEY, -- a, b\n "full name" text DEFAULT \'x, y\',\n amount numeric(10, 2),\n CONSTRAINT c UNIQUE (id),\n PRIMARY KEY (id)\n);') == {("sql", "User"): ["amount", "full name", "id"]}
    assert cols("-- CREATE TABLE no (id int);\n/* create table no2 (id int) */") == {}
    assert cols('export const a = pgTable("users", { id: serial("id").primaryKey(), mail: text("e_mail").default("a, b"), // x: text("no")\n }, (t) => ({}));') == {("drizzle", "users"): ["e_mail", "id"]}
    assert cols("model Post {\n  id Int @id\n  title String\n  @@index([title])\n}") == {("prisma", "post"): ["id", "title"]}
    assert cols("class A(Base):\n    __tablename__ = 'as'\n    id: Mapped[int] = mapped_column(primary_key=True)\n    n = Column(String)\n\nclass B(Base):\n    __tablename__ = 'bs'\n    m = Column(String)\n") == {("sqlalchemy", "as"): ["id", "n"], ("sqlalchemy", "bs"): ["m"]}
    assert cols("t = Table('core', meta, Column('x', Integer), Column('y', Integer))") == {("sqlalchemy", "core"): ["x", "y"]}
    assert cols("class P(models.Model):\n    name = models.CharField(max_length=3)\n    other = 1\n\nclass Q(models.Model):\n    age = models.IntegerField()\n    class Meta:\n        db_table = 'people'\n") == {("django", "p"): ["name"], ("django", "people"): ["age"]}
    assert cols('@Entity("users")\nexport class User {\n  @PrimaryGeneratedColumn()\n  id: number;\n\n  @Column({ nullable: true })\n  name?: string;\n}') == {("typeorm", "users"): ["id", "name"]}
    assert cols("") == {}


def test_code_structure():
    py = set(P.code_rows("python", "import a.b\nfrom .c import d\nclass K:\n    def m(self):\n        self.go(run())\n\ndef f():\n    m()\n"))
    assert py == {("import", "a.b", ""), ("import", ".c", ""), ("class", "K", ""), ("method", "m", "K"), ("function", "f", ""), ("call", "go", "m"), ("call", "run", "m"), ("call", "m", "f")}
    ts = set(P.code_rows("typescript", "import { a } from '@/x';\nimport './y'\nexport class K {\n  private go(x: number): void {\n    if (x) { run(x); }\n  }\n}\nexport const f = async (y: string) => {\n  go(y);\n};\nfunction g() { return f(1) }\n"))
    assert {("import", "@/x", ""), ("import", "./y", ""), ("class", "K", ""), ("method", "go", "K"), ("function", "f", ""), ("function", "g", ""), ("call", "run", "go"), ("call", "go", "f"), ("call", "f", "g")} <= ts
    go = set(P.code_rows("go", 'package a\nimport (\n\t"fmt"\n)\ntype T struct {}\nfunc (t *T) M() {}\nfunc F() {}\n'))
    assert go == {("import", "fmt", ""), ("class", "T", ""), ("method", "M", "T"), ("function", "F", "")}
    assert P.code_rows("python", "def (") == []


def test_documents(spark):
    text = "ID: RQ-1\nTitle: A\ntitle: B\r\n  Nested: no\nPolicy ID: P-9\nOwner: Ops team\n\n- rule_id: R1\n  operation: write\n  path_pattern: src/*\n  min_role: admin\n  effect: allow\n  source_priority: 7\n- rule_id: R2\n  effect: deny\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    assert {(r.key, r.value) for r in P.front_matter(df).collect()} == {("id", "RQ-1"), ("title", "B"), ("policy id", "P-9"), ("owner", "Ops team")}
    rules = {r.rule_id: r for r in P.rule_blocks(df).collect()}
    assert rules["R1"].source_priority == 7 and rules["R1"].policy_id == "P-9" and rules["R1"].path_pattern == "src/*"
    assert rules["R2"].effect == "deny" and rules["R2"].operation is None
    assert tuple(df.select(*P.document_metadata(df["text"])).first()) == ("RQ-1", "Ops team", None)


def test_replies(spark):
    rows = [(1, 'Sure\n```json\n{"a": ["src/x.ts"]}\n```'), (2, "none"), (3, 'x {"b": 1} y'), (4, None), (5, '{"c": "rq-12"}')]
    got = {r.id: r for r in P.decode_replies(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [got[i].parsed for i in range(1, 6)] == ['{"a": ["src/x.ts"]}', None, '{"b": 1}', None, '{"c": "rq-12"}']
    assert got[1].files == ["src/x.ts"] and got[5].requirements == ["RQ-12"]


def test_schema_operator(spark):
    df = spark.createDataFrame([(1, "create table t (a int);"), (2, "create table t (b int);"), (3, None), (4, "create table e ();")], "id int, text string")
    merged = {r.tbl: r.columns for r in P.merged_schema(P.parse_schemas(df)).collect()}
    assert merged == {"t": ["a", "b"], "e": []}
