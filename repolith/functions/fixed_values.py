"""Word lists, lookup tables, patterns and thresholds that define the results.

They are plain data. Every operator takes the table it uses as a parameter, so a caller can
replace any of them. Patterns stay inside the subset Java regex and RE2 share.
"""

# --- Fixed values: languages -------------------------------------------------------------
EXTENSION_LANGUAGES = {
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".py": "Python",
    ".go": "Go",
    ".rs": "Rust",
    ".java": "Java",
    ".kt": "Kotlin",
    ".rb": "Ruby",
    ".php": "PHP",
    ".cs": "C#",
    ".cpp": "C++",
    ".c": "C",
    ".swift": "Swift",
    ".scala": "Scala",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".hs": "Haskell",
    ".lua": "Lua",
    ".r": "R",
    ".dart": "Dart",
    ".vue": "Vue",
    ".svelte": "Svelte",
}
IGNORED_DIRS = (
    "vendor", "node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "target", "out",
)
NON_MODULE_DIRS = (
    "node_modules", ".git", ".github", ".vscode", "dist", "build", "coverage", ".changeset",
)

# --- Fixed values: technology signatures (kind, name, files, dependencies, minimum score) --
SIGNATURES = (
    ("framework", "Next.js", (), ("next",), 1),
    ("framework", "React", (), ("react", "react-dom"), 2),
    ("framework", "Vue", (), ("vue",), 1),
    ("framework", "Angular", (), ("@angular/core",), 1),
    ("framework", "Svelte", (), ("svelte",), 1),
    ("framework", "Express", (), ("express",), 1),
    ("framework", "Fastify", (), ("fastify",), 1),
    ("framework", "NestJS", (), ("@nestjs/core",), 1),
    ("framework", "Django", ("manage.py",), ("django",), 1),
    ("framework", "FastAPI", (), ("fastapi",), 1),
    ("framework", "Flask", (), ("flask",), 1),
    ("framework", "Gin", (), ("github.com/gin-gonic/gin",), 1),
    ("framework", "Fiber", (), ("github.com/gofiber/fiber",), 1),
    ("framework", "Actix", (), ("actix-web",), 1),
    ("framework", "Axum", (), ("axum",), 1),
    ("framework", "Spring Boot", (), ("spring-boot",), 1),
    ("framework", "Rails", ("Gemfile", "config/routes.rb"), (), 2),
    ("framework", "Laravel", ("artisan",), ("laravel/framework",), 1),
    ("test_framework", "Jest", (), ("jest",), 1),
    ("test_framework", "Vitest", (), ("vitest",), 1),
    ("test_framework", "Mocha", (), ("mocha",), 1),
    ("test_framework", "Pytest", (), ("pytest",), 1),
    ("test_framework", "RSpec", (), ("rspec",), 1),
    ("test_framework", "Go Test", ("go.mod",), (), 1),
    ("test_framework", "Playwright", (), ("@playwright/test", "playwright"), 1),
    ("test_framework", "Cypress", (), ("cypress",), 1),
    ("build_tool", "Webpack", (), ("webpack",), 1),
    ("build_tool", "Vite", (), ("vite",), 1),
    ("build_tool", "Turbopack", (), ("turbopack",), 1),
    ("build_tool", "esbuild", (), ("esbuild",), 1),
    ("build_tool", "Rollup", (), ("rollup",), 1),
    ("build_tool", "Gradle", ("build.gradle", "build.gradle.kts"), (), 1),
    ("build_tool", "Maven", ("pom.xml",), (), 1),
    ("build_tool", "Make", ("Makefile",), (), 1),
    ("build_tool", "Cargo", ("Cargo.toml",), (), 1),
    ("orm", "Prisma", (), ("prisma", "@prisma/client"), 1),
    ("orm", "TypeORM", (), ("typeorm",), 1),
    ("orm", "Drizzle", (), ("drizzle-orm",), 1),
    ("orm", "Sequelize", (), ("sequelize",), 1),
    ("orm", "SQLAlchemy", (), ("sqlalchemy",), 1),
    ("orm", "ActiveRecord", ("Gemfile",), ("activerecord",), 1),
    ("orm", "GORM", (), ("gorm.io/gorm",), 1),
    ("orm", "Diesel", (), ("diesel",), 1),
)

# --- Fixed values: questions per technology (name, question, context, blocking dependency) --
FRAMEWORK_QUESTIONS = (
    ("Next.js", "Do you use App Router or Pages Router (or both)?", "Next.js routing strategy affects component patterns, data fetching, and file structure", None),
    ("Next.js", "Are components Server Components by default, or mostly client-side?", "Determines whether to add 'use client' directives and how to handle state", None),
    ("Next.js", "What data fetching pattern do you use? (RSC async, React Query, SWR, tRPC, fetch in Server Actions)", "Affects how new features should load and cache data", None),
    ("Next.js", "Do you use Server Actions, API routes, or an external API for mutations?", "Determines where to put write operations and form handling", None),
    ("React", "What state management do you use? (Redux, Zustand, Jotai, MobX, Context, or none)", "Determines how new components should read/write shared state", None),
    ("React", "What styling approach? (Tailwind, CSS Modules, styled-components, Emotion, plain CSS)", "New components should follow the established styling pattern", None),
    ("React", "What routing library? (React Router, TanStack Router, or framework-provided)", "Affects how to add new pages and navigation", "next"),
    ("Vue", "Options API or Composition API?", "Vue 3 supports both — new components should match the project convention", None),
    ("Vue", "What state management? (Pinia, Vuex, or composables)", "Determines where shared state lives", None),
    ("Express", "What auth strategy? (JWT, sessions, OAuth, API keys)", "Auth approach affects middleware, route guards, and how to protect new endpoints", None),
    ("Express", "How are routes organized? (single file, feature folders, controller classes)", "Determines where to add new endpoints", None),
    ("Express", "Do you use raw SQL, a query builder, or an ORM for database access?", "Affects how to write data access code in new features", None),
    ("Fastify", "What auth strategy? (JWT, sessions, OAuth, API keys)", "Auth approach affects hooks, decorators, and how to protect new routes", None),
    ("Fastify", "Do you use the Fastify plugin system for feature organization?", "Determines how to structure new functionality", None),
    ("NestJS", "Do you use the default Express adapter or Fastify?", "Affects middleware compatibility and performance patterns", None),
    ("NestJS", "How do you handle auth? (@nestjs/passport, custom guards, external service)", "Determines guard and decorator patterns for new modules", None),
    ("Django", "Django REST Framework or plain Django views?", "DRF has serializers, viewsets, and routers — plain Django uses templates/forms", None),
    ("Django", "Class-based views or function-based views?", "New views should match the existing pattern", None),
    ("Django", "Do you use Celery or another task queue for background jobs?", "Affects how to handle long-running operations", None),
    ("FastAPI", "How do you organize routers? (single file, feature folders, APIRouter per domain)", "Determines where to add new endpoints", None),
    ("FastAPI", "What database pattern? (SQLAlchemy with sessions, Tortoise ORM, raw asyncpg)", "Affects how to write data access in new features", None),
    ("FastAPI", "Do you use Pydantic v1 or v2 model patterns?", "v1 and v2 have different syntax for validators and model config", None),
    ("Prisma", "Do you use raw SQL ($queryRaw) for complex queries, or strictly Prisma Client?", "Determines whether new features can use raw SQL or must use the Prisma query API", None),
    ("TypeORM", "Do you use Active Record or Data Mapper pattern with TypeORM?", "Active Record puts queries on entities; Data Mapper uses repositories", None),
    ("Drizzle", "Do you use Drizzle's relational queries or raw SQL builder for complex joins?", "Affects how to write data access for new features", None),
)
TRIBAL_QUESTIONS = (
    "What are the most common gotchas or pitfalls new developers hit in this codebase?",
    "Are there any environment setup steps or secrets/config not documented anywhere?",
    "Any areas of the codebase that are particularly fragile, slow, or tricky to work with?",
)

# --- Fixed values: path facts (kind, path, is a directory, label) ---------------------------
PATH_FACTS = (
    ("package_manager", "package-lock.json", False, "npm"),
    ("package_manager", "yarn.lock", False, "Yarn"),
    ("package_manager", "pnpm-lock.yaml", False, "pnpm"),
    ("package_manager", "bun.lockb", False, "Bun"),
    ("package_manager", "Pipfile.lock", False, "Pipenv"),
    ("package_manager", "poetry.lock", False, "Poetry"),
    ("package_manager", "Gemfile.lock", False, "Bundler"),
    ("package_manager", "go.sum", False, "Go Modules"),
    ("package_manager", "Cargo.lock", False, "Cargo"),
    ("package_manager", "composer.lock", False, "Composer"),
    ("ci", ".github/workflows", True, "GitHub Actions"),
    ("ci", ".gitlab-ci.yml", False, "GitLab CI"),
    ("ci", "Jenkinsfile", False, "Jenkins"),
    ("ci", ".circleci", True, "CircleCI"),
    ("ci", ".travis.yml", False, "Travis CI"),
    ("ci", "azure-pipelines.yml", False, "Azure Pipelines"),
    ("ci", "bitbucket-pipelines.yml", False, "Bitbucket Pipelines"),
    ("style_config", ".eslintrc.json", False, "ESLint"),
    ("style_config", ".eslintrc.js", False, "ESLint"),
    ("style_config", ".eslintrc.cjs", False, "ESLint"),
    ("style_config", "eslint.config.js", False, "ESLint (flat config)"),
    ("style_config", ".prettierrc", False, "Prettier"),
    ("style_config", ".prettierrc.json", False, "Prettier"),
    ("style_config", "prettier.config.js", False, "Prettier"),
    ("style_config", "biome.json", False, "Biome"),
    ("style_config", ".editorconfig", False, "EditorConfig"),
    ("style_config", "pyproject.toml", False, "pyproject.toml"),
    ("style_config", "rustfmt.toml", False, "rustfmt"),
    ("entry_point", "src/index.ts", False, "src/index.ts"),
    ("entry_point", "src/index.js", False, "src/index.js"),
    ("entry_point", "src/main.ts", False, "src/main.ts"),
    ("entry_point", "src/main.js", False, "src/main.js"),
    ("entry_point", "src/app.ts", False, "src/app.ts"),
    ("entry_point", "src/app.js", False, "src/app.js"),
    ("entry_point", "src/server.ts", False, "src/server.ts"),
    ("entry_point", "src/server.js", False, "src/server.js"),
    ("entry_point", "index.ts", False, "index.ts"),
    ("entry_point", "index.js", False, "index.js"),
    ("entry_point", "main.go", False, "main.go"),
    ("entry_point", "cmd/main.go", False, "cmd/main.go"),
    ("entry_point", "src/main.rs", False, "src/main.rs"),
    ("entry_point", "src/lib.rs", False, "src/lib.rs"),
    ("entry_point", "manage.py", False, "manage.py"),
    ("entry_point", "app.py", False, "app.py"),
    ("entry_point", "main.py", False, "main.py"),
    ("entry_point", "Program.cs", False, "Program.cs"),
    ("entry_point", "App.java", False, "App.java"),
    ("doc", "README.md", False, "README"),
    ("doc", "CONTRIBUTING.md", False, "CONTRIBUTING"),
    ("doc", "docs", True, "docs"),
    ("doc", "CHANGELOG.md", False, "CHANGELOG"),
)
CONFIG_FILES = (
    ("application.yml", "spring", "Spring Boot configuration"),
    ("application.yaml", "spring", "Spring Boot configuration"),
    ("application.properties", "spring", "Spring Boot configuration"),
    ("bootstrap.yml", "spring", "Spring Cloud bootstrap config"),
    ("Dockerfile", "docker", "Docker container definition"),
    ("docker-compose.yml", "docker", "Docker Compose services"),
    ("docker-compose.yaml", "docker", "Docker Compose services"),
    (".env", "env", "Environment variables"),
    (".env.example", "env", "Environment variables template"),
    ("pom.xml", "build", "Maven build configuration"),
    ("build.gradle", "build", "Gradle build configuration"),
    ("tsconfig.json", "build", "TypeScript configuration"),
    ("webpack.config.js", "build", "Webpack bundler configuration"),
    (".eslintrc.json", "lint", "ESLint configuration"),
    ("prettier.config.js", "lint", "Prettier configuration"),
)
CONFIG_PATTERN = (r"application-\w+\.yml$", "spring", "Environment-specific Spring config")

# --- Fixed values: architecture -------------------------------------------------------------
LAYER_DIRS = (
    "controllers", "routes", "handlers", "services", "repositories", "models", "entities", "domain",
    "infrastructure", "middleware", "utils", "helpers", "lib", "api", "pages", "views", "templates",
    "components",
)
LAYER_PARENTS = ("", "src/", "app/")
WORKSPACE_FILES = ("pnpm-workspace.yaml", "lerna.json", "turbo.json", "nx.json")
SERVICE_REGISTRY_WORDS = ("service-registry", "eureka", "cloud-gateway")
SERVER_WORDS = ("server.", "app.", "main.", "manage.py")
LIBRARY_INDEX_FILES = ("src/index.ts", "src/lib.rs")
IAC_DIRS = ("terraform", "k8s", "helm", "pulumi", "cdk")
IAC_FILES = ("docker-compose.yml", "docker-compose.yaml")
# (label, test, values): test is "contains", "equals" or "endswith"; any value counts
DATABASE_PATTERNS = (
    ("migrations", "contains", ("migration",)),
    ("Prisma", "equals", ("prisma/schema.prisma",)),
    ("raw SQL", "endswith", (".sql",)),
    ("GraphQL schema", "equals", ("schema.graphql", "schema.gql")),
    ("Knex", "contains", ("knex",)),
    ("Alembic", "contains", ("alembic",)),
)
API_PATTERNS = (
    ("REST/OpenAPI", "contains", ("openapi", "swagger")),
    ("GraphQL", "endswith", (".graphql", ".gql")),
    ("gRPC", "endswith", (".proto",)),
    ("tRPC", "contains", ("trpc",)),
    ("REST", "contains", ("routes", "controllers", "api/")),
)
SOURCE_PREFIXES = ("src/main/java", "src/main", "src", "app", "lib", "pkg", "internal")
MODULE_DEPTH = 4
MODULE_MIN_FILES = 3

# --- Fixed values: test files, one pattern per use ------------------------------------------
TEST_FILE_PATTERNS = {
    "convention": r"\.(test|spec)\.(ts|tsx|js|jsx)$|_test\.(go|py|rb)$",
    "architecture": r"\.(test|spec)\.(ts|tsx|js|jsx)$|_test\.(go|py|rb)$|Test\.java$",
    "pull_request": r"\.(test|spec)\.(ts|tsx|js|jsx)$|_test\.(go|py|rb)$|Test\.java$|test_.*\.py$",
    "library": r"/test/|Test\.java|\.test\.|\.spec\.",
}
TEST_DIRS = ("tests/", "test/", "__tests__/", "spec/")

# --- Fixed values: commit messages ----------------------------------------------------------
# (style, pattern) in order of precedence; "free" is the rest
COMMIT_STYLES = (
    ("conventional", r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\(.+?\))?!?:\s"),
    ("jira", r"^[A-Z]{2,10}-\d+\s"),
    ("github", r"^(?i)(closes?|fixes?|resolves?)\s+#\d+"),
    ("emoji", r"^[0-9#*\x{A9}\x{AE}\x{200D}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]+\s"),
    ("free", r""),
)
CONVENTIONAL_STRICT = r"^(feat|fix|docs|refactor|test|chore)\("
JIRA_STRICT = r"^[A-Z]{2,}-\d+"
TRIVIAL_SUBJECT = r"^(?i)(fix|changes|logs|merge|fx)$"
FLAGGED_SUBJECT = r"breaking|migrate|deprecat"
NAMING_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".rb", ".go", ".rs", ".java", ".php")
NAMING_STYLES = (
    ("kebab", r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$"),
    ("snake", r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"),
    ("camel", r"^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"),
    ("pascal", r"^[A-Z][a-zA-Z0-9]*$"),
)

# --- Fixed values: pull-request topics (label, title words, exact labels) -------------------
PR_TOPICS = (
    ("breaking-change", ("breaking",), ("breaking-change",)),
    ("security", ("security",), ("security",)),
    ("perf", ("perf", "performance"), ("performance",)),
    ("bugfix", ("fix", "bug"), ()),
    ("feature", ("feat", "feature"), ()),
    ("refactor", ("refactor",), ()),
    ("dependencies", ("deps", "dependab"), ()),
)

# --- Fixed values: dependency groups (pattern, group), first match wins ---------------------
DEPENDENCY_GROUPS = (
    (r"spring-boot-starter-web|spring-web|jakarta\.servlet", "web"),
    (r"spring-boot-starter-data-jpa|hibernate|jpa|liquibase|flyway", "database"),
    (r"spring-boot-starter-security|spring-security|oauth2|jwt", "security"),
    (r"redis|redisson|lettuce|caffeine|ehcache", "cache"),
    (r"sqs|kafka|rabbitmq|activemq|spring-cloud-stream", "messaging"),
    (r"prometheus|micrometer|actuator|metrics", "monitoring"),
    (r"junit|mockito|testcontainers|assertj|truth", "testing"),
    (r"swagger|openapi|springdoc", "api-docs"),
    (r"lombok", "code-gen"),
    (r"jackson|gson", "serialization"),
    (r"slf4j|logback|log4j", "logging"),
    (r"postgis|h3|jts|spatial", "geospatial"),
    (r"antlr", "parsing"),
    (r"guava|vavr|commons", "utility"),
    (r"okhttp|httpclient|feign|retrofit", "http-client"),
    (r"aws|amazon", "aws"),
    (r"slack", "slack"),
)
HIDDEN_GROUPS = ("other", "code-gen", "logging")

# --- Fixed values: type names ---------------------------------------------------------------
# (suffix or fragment, must end the name, role), first match wins
TYPE_ROLES = (
    ("Engine", True, "Processing engine"),
    ("Service", True, "Business service"),
    ("Controller", True, "REST controller"),
    ("Repository", True, "Data repository"),
    ("Adapter", True, "Adapter"),
    ("Mapper", True, "Data mapper"),
    ("Entity", True, "Database entity"),
    ("Config", False, "Configuration"),
    ("Helper", True, "Helper utility"),
    ("Handler", True, "Handler"),
    ("Factory", True, "Factory"),
    ("Strategy", True, "Strategy"),
    ("Builder", True, "Builder"),
    ("Validator", True, "Validator"),
    ("Filter", True, "Filter"),
    ("Interceptor", True, "Interceptor"),
    ("Listener", True, "Event listener"),
)
ANNOTATION_ROLES = {
    "@RestController": "REST controller",
    "@Controller": "MVC controller",
    "@Service": "service",
    "@Repository": "repository",
    "@Entity": "JPA entity",
    "@Component": "Spring component",
    "@Configuration": "Spring configuration",
    "@SpringBootApplication": "application entry point",
    "@Scheduled": "scheduled task",
    "@EventListener": "event handler",
}
LOMBOK_ANNOTATIONS = (
    "@Builder", "@Getter", "@Setter", "@Data", "@Value", "@AllArgsConstructor", "@NoArgsConstructor", "@Slf4j",
)

# --- Fixed values: directory purposes -------------------------------------------------------
DIRECTORY_PURPOSES = {
    "controller": "REST API controllers",
    "controllers": "REST API controllers",
    "service": "Business logic services",
    "services": "Business logic services",
    "repository": "Data access repositories",
    "repositories": "Data access repositories",
    "entity": "JPA/database entities",
    "entities": "JPA/database entities",
    "model": "Domain models",
    "models": "Domain models",
    "domain": "Core domain logic",
    "adapter": "Port adapters (hexagonal architecture)",
    "adapters": "Port adapters (hexagonal architecture)",
    "port": "Interface ports (hexagonal architecture)",
    "ports": "Interface ports (hexagonal architecture)",
    "mapper": "Data mapping/transformation",
    "mappers": "Data mapping/transformation",
    "config": "Configuration",
    "configuration": "Configuration",
    "infrastructure": "Infrastructure and cross-cutting concerns",
    "middleware": "Request/response middleware",
    "handler": "Event/request handlers",
    "handlers": "Event/request handlers",
    "util": "Utility functions",
    "utils": "Utility functions",
    "helpers": "Helper functions",
    "integration": "External service integrations",
    "web": "Web/HTTP layer",
    "api": "API layer",
    "persistence": "Data persistence layer",
    "core": "Core business domain",
    "rules": "Business rules engine",
    "cache": "Caching layer",
    "engine": "Processing engines",
    "strategy": "Strategy pattern implementations",
    "allocation": "Allocation logic",
    "simulation": "Simulation/what-if analysis",
    "sqs": "AWS SQS message processing",
    "jdbc": "Raw JDBC data access",
    "bo": "Business objects (transient models)",
    "constants": "System constants and configuration values",
    "test": "Tests",
    "tests": "Tests",
    "spec": "Test specifications",
    "migration": "Database migrations",
    "migrations": "Database migrations",
}
# (class-name suffix, purpose), first match wins
CLASS_SUFFIX_PURPOSES = (
    ("Controller", "REST controllers"),
    ("Service", "Service layer"),
    ("Repository", "Data access"),
    ("Entity", "Database entities"),
    ("Adapter", "Adapters"),
    ("Engine", "Processing engines"),
)

# --- Fixed values: content patterns ---------------------------------------------------------
IMPORT_SOURCE = r"\.(ts|tsx|js|jsx|mjs|java|py|go|rs)$"
RESOLVE_EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs")
JAVA_SOURCE_PREFIXES = ("src/main/java/", "src/", "")
PYTHON_SUFFIXES = (".py", "/__init__.py")
# (name, literals of which one must occur, smallest file count that is too few)
CODE_PATTERNS = (
    ("either", ("Either<",), 3),
    ("problem", ("ProblemHandling",), 0),
    ("autowired", ("@Autowired",), 5),
)
TEST_LIBRARY_PATTERNS = (
    ("mockito", ("MockitoExtension", "@Mock"), 2),
    ("truth", ("com.google.common.truth", "Truth.assertThat"), 2),
    ("assertj", ("org.assertj", "assertThat("), 2),
    ("display_name", ("ReplaceUnderscores", "@DisplayNameGeneration"), 2),
)
TODO_PATTERN = r"\b(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)"
# (language or "*", category, pattern)
RISK_RULES = (
    ("*", "secret", r"(?i)password"),
    ("*", "secret", r"(?i)secret"),
    ("*", "secret", r"(?i)api_key"),
    ("*", "secret", r"(?i)token"),
    ("*", "secret", r"(?i)private_key"),
    ("Java", "injection", r"nativeQuery\s*=\s*true"),
    ("Java", "injection", r"createQuery\("),
    ("Java", "injection", r"@Value\(.#\{"),
    ("Python", "injection", r"render_template_string"),
    ("Python", "command", r"os\.system"),
    ("Python", "command", r"shell\s*=\s*True"),
    ("TypeScript", "xss", r"dangerouslySetInnerHTML|innerHTML|document\.write"),
    ("TypeScript", "command", r"child_process"),
    ("JavaScript", "xss", r"dangerouslySetInnerHTML|innerHTML|document\.write"),
    ("JavaScript", "command", r"child_process"),
)
SCRIPT_NAMES = ("build", "test", "dev", "start", "lint", "typecheck", "format")

# --- Fixed values: scores -------------------------------------------------------------------
CONFIDENCE_CUTS = ((80, "A"), (65, "B"), (50, "C"), (35, "D"))
HEALTH_CUTS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
DIMENSION_MAX = (
    ("Project Identity", 20),
    ("Build & Run", 20),
    ("Architecture", 20),
    ("Code Patterns", 15),
    ("Domain Context", 15),
    ("Testing", 10),
)
RUBRIC_DIMENSIONS = 8
RUBRIC_FACTOR = 2.5

# --- Fixed values: limits -------------------------------------------------------------------
PAIR_MIN_COUNT = 3
THROTTLE_SECONDS = 300
STALE_COMMITS = 10
ALERT_FILES = 15
CACHE_TTL_HOURS = 24
