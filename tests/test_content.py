import json

from repolith.operators import content, deps, imports, structure, types

CONTENTS = "repo_id STRING, path STRING, text STRING"


def texts(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, t) for p, t in files.items()], CONTENTS)


SOURCES = {
    "src/a.ts": "import { b } from './b.js';\nimport type { C } from \"../lib\";\nimport './side';\nconst d = await import('./d');\nconst e = require(\"left-pad\");\n",
    "src/b.ts": "export class B {}\n",
    "src/d/index.ts": "",
    "lib/index.ts": "",
    "src/main/java/com/acme/Foo.java": "import com.acme.Bar;\nimport static com.acme.Util.run;\nimport java.util.List;\n",
    "src/main/java/com/acme/Bar.java": "",
    "app/main.py": "from pkg.mod import x\nimport pkg\nfrom .rel import y\n",
    "pkg/mod.py": "",
    "pkg/__init__.py": "",
    "cmd/main.go": "import (\n\t\"fmt\"\n\tlog \"github.com/x/log\"\n)\nimport \"os\"\n",
    "src/lib.rs": "use std::io;\nuse crate::core;\n",
}


def test_imports(spark, rows):
    files = texts(spark, SOURCES)
    resolved = imports.resolve_imports(imports.extract_imports(files), files.select("repo_id", "path"))
    assert rows(resolved, "src", "spec", "dst") == sorted(
        [
            ("src/a.ts", "./b.js", "src/b.ts"),
            ("src/a.ts", "../lib", "lib/index.ts"),
            ("src/a.ts", "./side", None),
            ("src/a.ts", "./d", "src/d/index.ts"),
            ("src/a.ts", "left-pad", None),
            ("src/main/java/com/acme/Foo.java", "com.acme.Bar", "src/main/java/com/acme/Bar.java"),
            ("src/main/java/com/acme/Foo.java", "com.acme.Util.run", None),
            ("src/main/java/com/acme/Foo.java", "java.util.List", None),
            ("app/main.py", "pkg.mod", "pkg/mod.py"),
            ("app/main.py", "pkg", "pkg/__init__.py"),
            ("app/main.py", ".rel", None),
            ("cmd/main.go", "fmt", None),
            ("cmd/main.go", "github.com/x/log", None),
            ("cmd/main.go", "os", None),
            ("src/lib.rs", "std::io", None),
            ("src/lib.rs", "crate::core", None),
        ],
        key=repr,
    )


def test_fan_in_counts_statements_and_importers(spark, rows):
    files = texts(spark, {"a.ts": "import './c';\nimport x from './c';\n", "b.ts": "import './c';\n", "c.ts": "import './d';\n", "d.ts": ""})
    edges = imports.import_edges(imports.resolve_imports(imports.extract_imports(files), files))
    assert rows(imports.fan_in(edges), "file", "n_imports", "fan_in", "rank") == [("c.ts", 3, 2, 1), ("d.ts", 1, 1, 2)]
    changed = spark.createDataFrame([("r", 1, "d.ts")], "repo_id STRING, change_id INT, path STRING")
    assert rows(imports.blast_radius(changed, edges, hops=2), "importer", "hop") == [("a.ts", 2), ("b.ts", 2), ("c.ts", 1)]


JAVA = """package x;
/** Old note. */
/**
 * Prices an order.
 * Slowly.
 * @author ann
 */
@Service
\t@AllArgsConstructor
public abstract class OrderService extends Base implements Run<T>, Stop {
}
class Second {}
"""


def test_types(spark, rows):
    found = types.extract_types(
        texts(
            spark,
            {
                "A.java": JAVA,
                "b.ts": "// class Nope here\nexport default class Thing {}\n  export interface ThingConfig {}\n",
                "c.py": "import x\n@dataclass\nclass A(Base, Mixin):\n    pass\n" + "#" * 120 + "\nclass B:\n",
                "d.go": "type S struct {\n}\ntype I interface {\n",
                "e.rs": "pub trait T {}\nstruct S;\n  enum Inner {}\n",
                "f.md": "class None {}",
            },
        )
    )
    got = {(r["file"], r["name"]): r for r in found.collect()}
    assert set(got) == {
        ("A.java", "OrderService"), ("b.ts", "Thing"), ("b.ts", "ThingConfig"), ("c.py", "A"), ("c.py", "B"),
        ("d.go", "S"), ("d.go", "I"), ("e.rs", "T"), ("e.rs", "S"),
    }
    java = got[("A.java", "OrderService")]
    assert java["annotations"] == ["@Service", "@AllArgsConstructor"] and java["super_types"] == ["Base", "Run", "Stop"]
    assert java["description"] == "Prices an order. Slowly." and java["loc"] == 13 and java["line_no"] == 10
    assert got[("c.py", "A")]["annotations"] == ["@dataclass"] and got[("c.py", "B")]["annotations"] == []
    assert got[("c.py", "A")]["super_types"] == ["Base", "Mixin"]
    assert got[("b.ts", "ThingConfig")]["description"] == "Configuration"
    assert (got[("d.go", "I")]["kind"], got[("e.rs", "T")]["kind"]) == ("interface", "trait")


COMPOSE = """version: "3"
services:
  web:
    image: x
    ports:
      - "8080:80"
      - 9090:9090
      - '7070:7070'
    depends_on:
      - "db"
      - cache
      - not a name
    # a comment
    environment:
      - A=1234:5678
  db:
    image: pg
volumes:
  data:
"""


def test_service_map(spark, rows):
    files = texts(spark, {"docker-compose.yml": COMPOSE, "docker-compose.staging.yml": "services:\n  other:\n"})
    found = content.service_map(files)
    assert rows(found, "path", "service", "port", "depends_on") == [
        ("docker-compose.staging.yml", "other", None, []),
        ("docker-compose.yml", "db", None, []),
        ("docker-compose.yml", "web", "9090", ["db", "cache"]),
    ]
    chosen = content.compose_files(files)
    assert rows(chosen, "path", "staging") == [("docker-compose.staging.yml", 1), ("docker-compose.yml", 0)]
    assert rows(content.compose_files(files, k=1), "path") == [("docker-compose.yml",)]
    assert rows(content.first_services(found, chosen)) == [("r", 2, "web, db")]


def test_lead_paragraph(spark, rows):
    files = texts(
        spark,
        {
            "1": "intro\n# T\n\n  one \ntwo\n\nthree",
            "2": "# T\n## Sub\nx",
            "3": "no title",
            "4": "T\n===\nlong " + "y" * 600,
            "5": "# T",
            "6": "# A\n---\nx",
        },
    )
    got = dict(rows(content.lead_paragraph(files), "path", "lead"))
    assert got["1"] == "one two" and set(got) == {"1", "4"} and len(got["4"]) == 605
    assert [len(x) for _, x in rows(content.lead_paragraph(files, chars=500), "path", "lead")] == [7, 500]


def test_description_order(spark, rows):
    pom = "<name>Ledger</name>\n<description>\n Books </description>"
    package = json.dumps({"description": "from package"})
    assert rows(content.project_description(texts(spark, {"README.md": "# T\nfirst", "pom.xml": pom}))) == [("r", "first")]
    assert rows(content.project_description(texts(spark, {"README.md": "none", "pom.xml": pom, "package.json": package}))) == [("r", "Ledger")]
    assert rows(content.project_description(texts(spark, {"package.json": package}))) == [("r", "from package")]


def test_todos_and_rules(spark, rows):
    files = texts(spark, {"a.ts": "x\n// TODO: do it \n TODOS no\n# FIXME", "x.min.js": "// TODO a", "b.py": "password = 1\nos.system(x)"})
    assert rows(content.scan_todos(files), "path", "line_no", "kind", "text") == [("a.ts", 2, "TODO", "do it"), ("a.ts", 4, "FIXME", "")]
    assert rows(content.rule_counts(content.scan_rules(files)), "category", "n_hits") == [("command", 1), ("secret", 1)]


def test_team_rules(spark, rows):
    files = texts(
        spark,
        {
            "code-review.rules": 'a\nDescription: "one"\nDescription:"two"',
            ".cursor/rules/a.md": "---\nx: 1\n---\nBody " + "z" * 2000,
            **{f".cursor/rules/{n}.md": "text" for n in "bcd"},
            ".cursor/rules/0.md": "  ",
        },
    )
    got = dict(rows(content.extract_rules(files), "path", "rule"))
    assert got["code-review.rules"] == "- one\n- two"
    assert len(got[".cursor/rules/a.md"]) == 2005 and got[".cursor/rules/a.md"].startswith("Body ")
    assert set(got) == {"code-review.rules", *(f".cursor/rules/{n}.md" for n in "abcd")}
    few = dict(rows(content.extract_rules(files, max_rules=1, max_files=2, max_chars=9), "path", "rule"))
    assert few == {"code-review.rules": "- one", ".cursor/rules/a.md": "Body zzzz"}


def test_build_commands(spark, rows):
    parent = "<modules><module>one</module><module>two</module></modules>spring-boot-maven-plugin antlr4-maven-plugin"
    files = texts(
        spark,
        {
            "app/pom.xml": parent, "app/one/pom.xml": "<x/>", "app/two/pom.xml": "<x/>", "app/mvnw": "",
            "app/one/src/main/resources/application-local.yml": "", "app/one/src/main/resources/application-dev.yml": "",
            "package.json": json.dumps({"scripts": {"build": "tsc", "deploy": "x", "lint": "eslint"}}), "yarn.lock": "",
            "Makefile": "all: x\n\tcc\nbuild-it:\n", "Dockerfile": "", "gradlew": "", "build.gradle": "",
        },
    )
    got = {(r["name"], r["command"]) for r in content.build_commands(files, files, distinct_names=False).collect()}
    assert got == {
        ("build", "cd app && ./mvnw clean package -DskipTests"), ("test", "cd app && ./mvnw test"),
        ("run", "cd app && ./mvnw spring-boot:run"), ("generate-sources", "cd app && ./mvnw generate-sources"),
        ("build-module", "cd app && ./mvnw clean package -pl <module-name> -am"),
        ("run-local", "cd app && ./mvnw spring-boot:run -Dspring-boot.run.profiles=local"),
        ("build", "./gradlew build"), ("test", "./gradlew test"), ("build", "yarn build"), ("lint", "yarn lint"),
        ("all", "make all"), ("build-it", "make build-it"), ("docker-build", "docker build -f Dockerfile -t app ."),
    }
    unique = {r["name"]: r["command"] for r in content.build_commands(files, files).collect()}
    assert unique["build"] == "cd app && ./mvnw clean package -DskipTests"


PACKAGE = json.dumps(
    {
        "dependencies": {"react": "^18.0.0", "react-dom": "^18.0.0", "next": "^14.0.0"},
        "devDependencies": {"vitest": "^1.0.0", "typescript": "^5.0.0"},
    }
)


def test_signatures(spark, rows):
    files = texts(spark, {"package.json": PACKAGE, "package-lock.json": "{}"})
    names = deps.read_manifests(files)
    detected = deps.detect_signatures(names, files)
    assert {r["name"] for r in detected.collect()} == {"Next.js", "React", "Vitest", "Vite"}
    assert rows(structure.path_facts(files), "kind", "label") == [("package_manager", "npm")]
    asked = {r["question"] for r in deps.framework_questions(detected, names).collect()}
    assert len(asked) == 6 and not any("routing library" in q for q in asked)


def test_manifests(spark, rows):
    files = texts(
        spark,
        {
            "svc/pom.xml": "<dependency><groupId>g</groupId>\n<artifactId>spring-boot-starter-web</artifactId>\n<version>1</version></dependency><dependency> <groupId>org.x</groupId> <artifactId>redisson</artifactId></dependency>",
            "go.mod": "require (\n\tgorm.io/gorm v1\n)", "Cargo.toml": "[dependencies]\naxum = \"1\"\n", "Gemfile": "gem 'rails'\n",
            "requirements.txt": "# c\nDjango[x]>=4\n-r b.txt\n\n", "package.json": "{broken",
        },
    )
    assert {r["dep"] for r in deps.read_manifests(files).collect()} == {"spring-boot-starter-web", "redisson", "gorm.io/gorm", "axum", "rails", "django"}
    assert rows(deps.versioned_deps(files)) == [("r", "g:spring-boot-starter-web", "1", "web"), ("r", "org.x:redisson", "", "cache")]


def test_architecture_fixture(spark):
    paths = ["src/index.ts", "src/server.ts", "src/controllers/auth.ts", "src/services/user.ts", "src/models/user.ts", "tests/auth.test.ts", "Dockerfile", "docker-compose.yml", "prisma/schema.prisma"]
    files = texts(spark, {p: "" for p in paths})
    got = structure.architecture(files).first()
    assert got["style"] == "monolith" and got["layers"] == ["controllers", "services", "models"]
    assert got["entry_points"] == ["src/index.ts", "src/server.ts"] and got["has_docker"] and got["has_iac"]
    assert got["db_patterns"] == ["Prisma"] and got["api_patterns"] == ["REST"]
    assert structure.test_layout(files).first()["layout"] == "separate-dir"
    styles = {
        "monorepo": ["packages/a/x.ts", "turbo.json"], "microservices": ["services/a/x.ts"], "library": ["src/index.ts"],
    }
    for style, names in styles.items():
        assert structure.architecture(texts(spark, {p: "" for p in names})).first()["style"] == style


def test_modules(spark, rows):
    paths = [f"src/core/deep/er/x{k}.ts" for k in range(3)] + ["mysrc/a/1.ts", "mysrc/a/2.ts", "mysrc/a/3.ts"]
    paths += ["svc/user/pom.xml", "svc/user/src/main/App.java"]
    files = texts(spark, {p: "" for p in paths})
    freq = spark.createDataFrame([("r", "src/core/deep/er/x1.ts", 4)], "repo_id STRING, path STRING, change_count BIGINT")
    got = structure.module_rollup(files, freq)
    assert rows(got, "dir", "parent_dir", "file_count", "change_count") == [
        ("src/core", None, 3, 4), ("src/core/deep", "src/core", 3, 4), ("src/core/deep/er", "src/core/deep", 3, 4), ("svc/user", None, 2, 0),
    ]
    assert rows(structure.module_roots(files, freq), "dir") == [("src/core",), ("svc/user",)]
    top = {r["dir"]: r["key_files"] for r in got.collect()}
    assert top["src/core"] == ["src/core/deep/er/x1.ts", "src/core/deep/er/x0.ts", "src/core/deep/er/x2.ts"]


def test_flatten_modules(spark, rows):
    nested = spark.createDataFrame(
        [("r", "a", [("a/b", [("a/b/c",)])])],
        "repo_id STRING, dir STRING, children ARRAY<STRUCT<dir: STRING, children: ARRAY<STRUCT<dir: STRING>>>>",
    )
    assert rows(structure.flatten_modules(nested)) == [("r", "a"), ("r", "a/b"), ("r", "a/b/c")]


def test_languages_fixture(spark):
    paths = ["src/index.ts", "src/types.ts", "src/app.tsx", "src/utils.js", "main.py", "package.json", "tsconfig.json", "dist/x.go"]
    got = {r["language"]: r for r in structure.language_share(texts(spark, {p: "" for p in paths})).collect()}
    assert set(got) == {"TypeScript", "JavaScript", "Python"}
    assert got["TypeScript"]["is_primary"] and got["TypeScript"]["percentage"] == 60
