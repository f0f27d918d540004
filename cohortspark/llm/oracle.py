"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op2_block_naming": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op6_water_filling": r"""
        with sizes as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
            from documents),
        sources as (
            select source, sum(size)::bigint as source_size,
                   [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight
            from sizes group by source),
        ranked as (
            select *, 3 * source_size as room, row_number() over (order by (3 * source_size)::double / weight, source nulls last) as place,
                   sum(source_size) over ()::bigint as total from sources),
        levels as (
            select *, (total - coalesce(sum(room) over (order by place rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
                   (sum(weight) over (order by place rows between current row and unbounded following))::bigint as weights_left
            from ranked),
        level as (select arg_min(rest, place) as rest, arg_min(weights_left, place) as weights_left, min(place) as place
                  from levels where weight * rest <= room * weights_left),
        targets as (
            select s.source, s.source_size,
                   case when s.place >= l.place then least((s.weight * l.rest)::double / l.weights_left::double, s.room::double)
                        else s.room::double end as target
            from levels s, level l),
        draws as (
            select d.doc_id, d.size, t.source_size, t.target,
                   ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 as draw,
                   case when t.source_size > 0 then t.target / t.source_size::double else 0.0 end as share
            from sizes d join targets t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               least(3 * size, floor(size::double * share + draw)::bigint)::bigint as taken
        from draws
    """,
    "op8_sorted_runs": r"""
        with lines as (
            select doc_id, pos, list_extract(parts, pos) as line
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
                 unnest(range(1, len(parts) + 1)) as u(pos)),
        keys as (
            select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        common as (select key from keys where key <> '' group by key having count(distinct doc_id) >= 10)
        select k.doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (c.key is null), '')) as kept_sha256
        from keys k left join common c on k.key = c.key group by k.doc_id
    """,
}
