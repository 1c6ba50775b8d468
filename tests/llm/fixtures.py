"""Small tables with null, empty, repeated and long rows, and DuckDB over them."""

import duckdb


def documents(spark, folder, extra=()):
    boiler = "Subscribe to our newsletter today"
    rows = []
    for i in range(60):
        source = ["src0", "src1", "src5", "web", None][i % 5] if i % 7 else "src0"
        body = "\n".join(f"line {i} {j} " + " ".join(f"w{(i * 31 + j * 7 + k) % 97}" for k in range(6)) for j in range(i % 6 + 1))
        rows.append((i, f"{body}\n{boiler}" if i % 3 else f"{body}\n \n{boiler}  ", ["en", "de", "fr", None][i % 4], source, None))
    rows += [(100, None, "en", "src0", 1), (101, "", "en", "src1", 0), (102, "\n\n", None, None, 2), (103, boiler, "es", "src2", 3), (7, rows[7][1], "en", "src0", 5), (7, rows[7][1], "en", "src0", 5), (None, "no id", "en", "src1", 5), (104, "long " * 30_000, "en", "src9", 5)]
    rows += list(extra)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def sql(folder, query, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(query)
    names = [d[0] for d in cursor.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall()), key=repr)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
