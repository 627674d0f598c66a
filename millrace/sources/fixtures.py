"""Small code files to extract from, as no table holds code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = [
    (
        "src/app.js", "javascript",
        "import express from 'express';\nimport { loadUser, saveUser as keep } from './store/users';\nconst { PORT = 3000, DB_URL: url } = process.env;\n"
        "const app = express();\nexport function start(port) {\n  const key = process.env.API_KEY;\n  return app.listen(port, () => loadUser('startup-user'));\n}\n"
        "app.use('/api', userRouter);\napp.get('/health', (req, res) => res.send(\"service healthy\"));\nexport default start;\n",
    ),
    (
        "src/store/users.js", "javascript",
        "const db = require('../db');\nasync function loadUser(id) {\n  return db.query(\"select user\", id);\n}\nfunction saveUser(user) {\n  if (!user) throw new Error('missing user');\n  return db.query('insert user', user);\n}\n"
        "router.post('/users/:id', saveUser);\nmodule.exports = { loadUser, keep: saveUser };\n",
    ),
    ("src/db.js", "javascript", "const pool = connect(process.env['DATABASE_URL']);\nexports.query = function (sql) { return pool.run(sql); };\n"),
    ("src/types.ts", "typescript", "export class Account {\n  id = 'account-id';\n}\nexport const build = async (id) => new Account(id);\nclass Hidden {}\nexport { Hidden };\n"),
    ("tools/load.py", "python", "from os import path, environ\nimport json\n\nclass Loader:\n    def run(self):\n        return json.loads(path.join('data-dir'))\n\ndef main():\n    return Loader().run()\n"),
    ("cmd/main.go", "go", "package main\nimport \"fmt\"\nfunc (s *Server) Serve() {\n  fmt.Println(\"serving now\")\n}\nfunc main() { Serve() }\n"),
    ("lib/shape.rs", "rust", "use std::fmt::Display;\npub struct Shape { side: u32 }\npub fn area(s: &Shape) -> u32 { s.side * s.side }\nfn hidden() {}\n"),
    ("Main.java", "java", "import java.util.List;\npublic final class Main {\n  public static void main(String[] args) { run(args); }\n}\n"),
    ("engine/core.cpp", "cpp", "#include \"core.h\"\n#include <vector>\nint run() { return 0; }\n"),
    ("empty.js", "javascript", "// nothing here\n"),
]


def code_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, language string, source string")
