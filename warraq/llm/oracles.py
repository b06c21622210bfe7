"""SQL of the pN_ queries that SQL can express."""

_SOURCE = "lower(trim(regexp_replace(coalesce(source_name, ''), '\\s+', ' ', 'g')))"

ORACLES: dict[str, str] = {
    "p2_found": f"""
        SELECT article_id FROM (
            SELECT id AS article_id,
                   row_number() OVER (
                       PARTITION BY {_SOURCE}
                       ORDER BY CASE WHEN isnan(reliability_score) OR reliability_score NOT BETWEEN 0 AND 1 THEN -1
                                     ELSE coalesce(reliability_score, -1) END DESC,
                                published_at DESC NULLS LAST, id) AS place,
                   (SELECT floor(count(*) * 0.05 + 1e-9) FROM articles) AS cap
            FROM articles)
        WHERE place > cap""",
    "p2_by_month": f"""
        WITH r AS (
            SELECT id AS article_id, {_SOURCE} AS source, coalesce(strftime(published_at, '%Y-%m'), '') AS month,
                   row_number() OVER (
                       PARTITION BY {_SOURCE}, strftime(published_at, '%Y-%m')
                       ORDER BY CASE WHEN isnan(reliability_score) OR reliability_score NOT BETWEEN 0 AND 1 THEN -1
                                     ELSE coalesce(reliability_score, -1) END DESC,
                                published_at DESC NULLS LAST, id) AS rank
            FROM articles),
        s AS (SELECT source, month, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total,
                     (SELECT floor(count(*) * 0.05 + 1e-9) FROM articles) AS cap FROM r GROUP BY source, month),
        x AS (SELECT *, CASE WHEN cap >= total THEN n ELSE (cap * n)::DOUBLE / total END AS exact FROM s),
        f AS (SELECT *, floor(exact) AS whole, row_number() OVER (PARTITION BY source ORDER BY exact - floor(exact) DESC, month) AS place,
                     least(cap, total) - sum(floor(exact)) OVER (PARTITION BY source) AS spare FROM x)
        SELECT article_id, r.source, r.month, rank, (whole + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS slots
        FROM r JOIN f ON r.source = f.source AND r.month = f.month
        WHERE rank <= whole + CASE WHEN place <= spare THEN 1 ELSE 0 END""",
}
