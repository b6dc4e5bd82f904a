"""SQL of the six-panel top values, shared by queries."""


def sql(e: str, x: str, secret: str, agent_label: str, where: str, k: int = 10) -> str:
    params = (
        "SELECT DISTINCT row, name, value FROM (SELECT row, trim(url_decode(replace(split_part(y, '=', 1), '+', ' '))) AS name, trim(url_decode(replace(CASE WHEN contains(y, '=') THEN substr(y, strpos(y, '=') + 1) ELSE '' END, '+', ' '))) AS value "
        "FROM (SELECT row, unnest(string_split(substr(t, strpos(t, '?') + 1), '&')) AS y FROM s WHERE contains(t, '?')) WHERE split_part(y, '=', 1) <> '')"
    )
    label = f"concat(name, '=', CASE WHEN regexp_matches(name, '(?i){secret}') THEN '<redacted>' WHEN value = '' THEN '<empty>' ELSE value END)"
    return (
        f"{e}, {x}, s AS (SELECT * FROM x WHERE {where}), pv AS ({params}), every AS (SELECT 'ips' AS panel, ip AS value FROM s UNION ALL SELECT 'paths', path FROM s UNION ALL SELECT 'userAgents', {agent_label} FROM s "
        f"UNION ALL SELECT 'statuses', CAST(status AS VARCHAR) FROM s UNION ALL SELECT 'params', name FROM (SELECT DISTINCT row, name FROM pv) UNION ALL SELECT 'paramValues', v FROM (SELECT DISTINCT row, {label} AS v FROM pv)) "
        f"SELECT panel, value, n AS \"count\" FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, value) AS i FROM (SELECT panel, value, count(*) AS n FROM every WHERE value NOT IN ('', '-') GROUP BY 1, 2)) WHERE i <= {k}"
    )
