"""DuckDB SQL for the named queries. Figures are moved by 1e-9 before they are rounded: means of short decimals often lie on a tie."""

from __future__ import annotations

from diurna.plans.queries import DEVICE_ROWS
from diurna.schema import DEVICE_LABELS, NORMAL_RANGES
from diurna.sources.vitals import EVENT_SIGNALS

_SIGNALS = ", ".join(f"('{n}', {lo}, {hi})" for n, _, lo, hi in EVENT_SIGNALS)

#: samples s, bounds b, base windows h, and what is made of them. Window starts and ends in hours since the epoch.
_CTE = f"""
with recursive s as (select 'P' || lpad(cast(user_id % 2 + 1 as varchar), 4, '0') as patient_id, event_type as signal_type, epoch_us(ts) // 1000 as t, value from events),
b as (select * from (values {_SIGNALS}) v(signal_type, lo, hi)),
good as (select s.* from s join b using (signal_type) where value between lo and hi),
h as (select patient_id, signal_type, t // 3600000 as hr, count(*) as n, median(value) as median, coalesce(stddev_samp(value), 0) as sd, least(1.0, count(*) / 3.0) as completeness from good group by all),
c0 as (select patient_id, signal_type, hr - k + 24 as e, cos(2 * pi() * hr / 24) as c, sin(2 * pi() * hr / 24) as s, median as y from h, (select unnest(range(0, 24)) as k)),
c1 as (select patient_id, signal_type, e, count(*) as n, covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(c, y) as cy, covar_pop(s, y) as sy, covar_pop(y, y) as yy, avg(c) as mc, avg(s) as ms, avg(y) as my from c0 group by all having count(*) >= 12),
c2 as (select *, (cy * ss - sy * cs) / nullif(cc * ss - cs * cs, 0) as b1, (sy * cc - cy * cs) / nullif(cc * ss - cs * cs, 0) as b2 from c1),
fit as (select patient_id, signal_type, e, n, my - b1 * mc - b2 * ms as mesor, sqrt(b1 * b1 + b2 * b2) as amplitude, atan2(-b2, b1) as acrophase, (b1 * cy + b2 * sy) / nullif(yy, 0) as r2 from c2),
w0 as (select patient_id, signal_type, hr - k + 120 as e, hr, median from h, (select unnest(range(0, 120)) as k)),
w1 as (select patient_id, signal_type, e, count(*) as present, avg(median) as mean from w0 group by all having count(*) >= 0.7 * 120),
filled as (select w1.patient_id, w1.signal_type, w1.e, i, coalesce(w0.median, w1.mean) as x from w1 cross join (select unnest(range(0, 120)) as i) g left join w0 on w0.patient_id = w1.patient_id and w0.signal_type = w1.signal_type and w0.e = w1.e and w0.hr = w1.e - 120 + i),
iv0 as (select *, x - lag(x) over (partition by patient_id, signal_type, e order by i) as d, avg(x) over (partition by patient_id, signal_type, e) as m, avg(x) over (partition by patient_id, signal_type, e, i % 24) as mb from filled),
iv as (select patient_id, signal_type, e, case when sum((x - m) ** 2) > 0 then 120 * (sum((mb - m) ** 2) / 5) / (24 * sum((x - m) ** 2)) end as is_stability, case when sum((x - m) ** 2) > 0 then 120 * sum(d * d) / (119 * sum((x - m) ** 2)) else 0 end as iv_variab from iv0 group by all),
scale as (select j, 2.0 * 2 ** (j / 8.0) as period, 2.0 * 2 ** (j / 8.0) * (6 + sqrt(38)) / (4 * pi()) as sc from (select unnest(range(0, 37)) as j)),
psi as (select k, j, period, sqrt(2 * pi() * sc) * pi() ** (-0.25) * exp(-0.5 * (sc * 2 * pi() * k / 120 - 6) ** 2) as p from scale, (select unnest(range(1, 61)) as k)),
dft as (select patient_id, signal_type, e, k, sum(x * cos(2 * pi() * k * i / 120)) as re, sum(x * sin(2 * pi() * k * i / 120)) as im from filled, (select unnest(range(1, 61)) as k) group by all),
one as (select hr, median from h where patient_id = 'P0001' and signal_type = 'view'),
weights as (select k, sum(p * p) as wt, sum(case when period between 20 and 28 then p * p else 0 end) as wb from psi group by k),
cwt as (select patient_id, signal_type, e, case when sum((re * re + im * im) * wt) > 1e-12 then sum((re * re + im * im) * wb) / sum((re * re + im * im) * wt) else 0 end as cri from dft join weights using (k) group by all),
spec as (select patient_id, signal_type, e, round(period, 6) as period, round(sum((re * re + im * im) * p * p) / (120.0 * 120), 3) as power from dft join psi using (k) group by patient_id, signal_type, e, period),
met as (select patient_id, signal_type, 'cosinor' as method, e, mesor, amplitude, acrophase, r2, null::double as cri, null::double as is_stability, null::double as iv_variab from fit
 union all select patient_id, signal_type, 'cwt', e, null, null, null, null, cri, null, null from cwt union all select patient_id, signal_type, 'isiv', e, null, null, null, null, null, is_stability, iv_variab from iv),
kinds as (select * from (values (['all'], ['click', 'view'], 'amplitude_drop', 48.0, 200.0, 0.25, 12.0, 0.5), (['p0001'], ['all'], 'phase_shift', 240.0, 400.0, 6.0, 24.0, 0.5), (['p0002', 'p9'], ['error'], 'fragmentation', 400.0, 500.0, 0.8, 0.0, 1.5)) v(ps, ss, type, a, z, m, ramp, bout)),
truth as (select patient_id, signal_type, kinds.* from (values ('P0001'), ('P0002')) p(patient_id), b, kinds where (list_contains(ps, 'all') or list_contains(ps, lower(patient_id))) and (list_contains(ss, 'all') or list_contains(ss, signal_type))),
ev as (select patient_id, signal_type, type as event_type, cast(1704067200000 + a * 3600000 as bigint) as start_time, cast(1704067200000 + z * 3600000 as bigint) as end_time, cast(m as double) as magnitude, '{{"rampHours":' || cast(ramp as varchar) || ',"boutHours":' || cast(bout as varchar) || '}}' as params_json from truth),
lat as (select patient_id, signal_type, arg_max(amplitude, e) filter (method = 'cosinor') as amplitude, arg_max(acrophase, e) filter (method = 'cosinor') as acrophase, arg_max(r2, e) filter (method = 'cosinor' and r2 is not null) as r2, arg_max(cri, e) filter (cri is not null) as cri, arg_max(is_stability, e) filter (is_stability is not null) as is_stability, arg_max(iv_variab, e) filter (iv_variab is not null) as iv_variab from met group by all)
"""

_K = "patient_id, signal_type"
_E = "e * 3600000 as window_end"
_H = "hr * 3600000 as window_start"


def _r(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n} + 1e-9, {digits}) as {n}" for n in names)


_SPEC = f"select {_K}, {_E}, period, power from spec"
_DEVICE = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in DEVICE_ROWS)
_LABELS = ", ".join(f"('{a}', '{b}')" for a, b in DEVICE_LABELS.items())
_DEVICE_CTE = rf"""with d0 as (select *, coalesce(nullif(trim(sub), ''), nullif(trim(lab), '')) as label from (values {_DEVICE}) v(t, lab, sub, val, unit, p)),
d1 as (select d0.*, m.signal, try_cast(trim(val) as double) as value, case when regexp_full_match(trim(t), '\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{{0,9}})? ([+-]\d\d:\d\d|Z)') then epoch_ms(cast(replace(trim(t), ' +', '+') as timestamptz)) end as ms from d0 left join (values {_LABELS}) m(l, signal) on regexp_replace(upper(coalesce(label, '')), '[^A-Z0-9]', '', 'g') = m.l),
d as (select *, case when signal is null then 'unmapped' when p <> '7' then 'filtered' when value is null then 'badValue' when ms is null then 'badTime' else 'ok' end as disposition from d1)
"""

# the clamped channels of a colour temperature t * 100
_CHANNELS = (
    "case when t <= 66 then 255 else 329.698727446 * (t - 60) ** -0.1332047592 end",
    "case when t <= 66 then 99.4708025861 * ln(t) - 161.1195681661 else 288.1221695283 * (t - 60) ** -0.0755148492 end",
    "case when t >= 66 then 255 when t <= 19 then 0 else 138.5177312231 * ln(t - 10) - 305.0447927307 end",
)
_RGB = "'rgb(' || " + " || ',' || ".join(f"cast(floor(greatest(0, least(255, {c}))) as bigint)" for c in _CHANNELS) + " || ')'"
_LIGHT = """select *, 0.5 * (1 + cos(2 * pi() * (i * 0.5 - pk) / 24)) as sh, 0.05 + 0.2 * st as fl, 2300 + 400 * st as ni, 6500 - 1500 * st as da from (select patient_id, greatest(0, least(1, coalesce({strength}, 0))) as st, ((-acrophase * 24 / (2 * pi())) % 24 + 24) % 24 as pk from lat where signal_type = 'view' and acrophase is not null) q, (select unnest(range(0, 48)) as i)"""

_ONE = "patient_id = 'P0001' and signal_type = 'view'"

_BODIES = {
    "dead_letter": f"select s.{_K.replace(', ', ', s.')}, t as event_time, value, 'count' as unit, printf('out_of_range[%.1f,%.1f]', cast(lo as double), cast(hi as double)) as reason from s join b using (signal_type) where not value between lo and hi",
    "tumbling_aggregate": f"select {_K}, {_H}, n, {_r('median', 'sd', 'completeness')} from h",
    "cosinor": f"select {_K}, {_E}, n, {_r('mesor', 'amplitude', 'r2')}, round(cos(acrophase), 4) as cos_phase, round(sin(acrophase), 4) as sin_phase from fit",
    "gap_fill": f"select {_K}, {_E}, cast(i as int) as i, {_r('x')} from filled",
    "stability": f"select {_K}, {_E}, {_r('is_stability', 'iv_variab')} from iv",
    "band_index": f"select {_K}, {_E}, {_r('cri')} from cwt",
    "long_windows": f"select {_K}, {_E}, {_r('cri', 'is_stability', 'iv_variab')} from cwt join iv using (patient_id, signal_type, e)",
    "scalogram": _SPEC,
    "spectrum_share": f"select {_K}, {_E}, arg_min(period, (-power, period)) as peak_period, round(case when sum(power) > 0 then sum(case when period between 20 and 28 then power else 0 end) / sum(power) else 0 end, 4) as share from spec group by {_K}, e",
    "spectrum_correlation": "select a.patient_id, a.signal_type as signal_a, b.signal_type as signal_b, round(corr(a.power, b.power), 3) as shape_corr from (select *, max(e) over (partition by patient_id, signal_type) as l from spec) a join (select *, max(e) over (partition by patient_id, signal_type) as l from spec) b on a.patient_id = b.patient_id and a.period = b.period and a.signal_type < b.signal_type where a.e = a.l and b.e = b.l group by all",
    "metrics_table": f"select {_K}, method, {_E}, {_r('mesor', 'amplitude', 'acrophase', 'r2', 'cri', 'is_stability', 'iv_variab')} from met",
    "profile": "select signal_type, count(*) as n, count(distinct patient_id) as n_patients, min(t) as first, max(t) as last, round((max(t) - min(t)) / 86400000.0, 4) as span_days, count(*) filter (value > 100) as n_high from s group by 1",
    "difference": f"select * from (select {_K}, {_H}, round(median - lag(median) over (partition by {_K} order by hr) + 1e-9, 4) as step from h) where step is not null",
    "phase_profile": f"select {_K}, cast(hr % 24 as int) as hour, round(avg(median) + 1e-9, 4) as mean, count(*) as n from h group by {_K}, hr % 24",
    "replay_all": f"select {_K}, t as timestamp, value from s",
    "replay_order": f"select {_K}, t as timestamp, value from s order by t, {_K}, value limit 100",
    "stride": f"select {_K}, {_H}, {_r('median')} from (select *, row_number() over (partition by {_K} order by hr) - 1 as i, count(*) over (partition by {_K}) as m from h) where i % greatest(1, cast(ceil(m / 90.0) as bigint)) = 0",
    "q1_patients": "select patient_id, cast(to_json(list_sort(list(distinct signal_type))) as varchar) as signals from h group by 1",
    "q2_medians": f"select hr * 3600000 as t, round(median + 1e-9, 4) as value, {_r('completeness')} from h where patient_id = 'P0001' and signal_type = 'view'",
    "q3_metrics": f"select method, e * 3600000 as t, {_r('mesor', 'amplitude', 'acrophase', 'r2', 'cri', 'is_stability', 'iv_variab')} from met where patient_id = 'P0001' and signal_type = 'view'",
    "q4_truth": "select * from ev where patient_id = 'P0001' and signal_type = 'view'",
    "q5_overview": f"""select 'median' as part, hr * 3600000 as t, {_r('median', 'completeness')}, null::double as amplitude, null::double as r2, null::double as acrophase, null::double as mesor, null::double as cri, null::double as is_stability, null::double as iv_variab, null::varchar as event_type, null::bigint as end_time, null::double as magnitude from h where {_ONE}
 union all select case method when 'cwt' then 'cri' else method end, e * 3600000, null, null, {_r('amplitude', 'r2', 'acrophase', 'mesor', 'cri', 'is_stability', 'iv_variab')}, null, null, null from met where {_ONE}
 union all select 'ground_truth', start_time, null, null, null, null, null, null, null, null, null, event_type, end_time, magnitude from ev where {_ONE}""",
    "q6_scalogram": """select (lo + n) * 3600000 as window_end, period, cast(i as int) as i, round((sum(p * (re * cos(2 * pi() * k * i / n) + im * sin(2 * pi() * k * i / n))) ** 2 + sum(p * (re * sin(2 * pi() * k * i / n) - im * cos(2 * pi() * k * i / n))) ** 2) / (cast(n as double) * n), 3) as power
 from (select lo, n, k, round(period, 6) as period, re, im, sqrt(2 * pi() * sc) * pi() ** (-0.25) * exp(-0.5 * (sc * 2 * pi() * k / n - 6) ** 2) as p from
 (select lo, n, k, sum(x * cos(2 * pi() * k * i / n)) as re, sum(x * sin(2 * pi() * k * i / n)) as im from
 (select lo, n, i, coalesce(median, mean) as x from (select min(hr) as lo, max(hr) - min(hr) + 1 as n, avg(median) as mean from one having count(*) >= 60) z, unnest(range(0, n)) g(i) left join one on hr = lo + i) f, unnest(range(1, n // 2 + 1)) q(k) group by all), scale) w,
 unnest(range(0, n, cast(ceil(n / 900.0) as bigint))) t(i) group by lo, n, period, i""",
    "q7_light": f"""select patient_id, cast(i as int) as step, round(i * 0.5, 3) as hour, round(fl + (1 - fl) * sh, 4) as intensity, round(pk, 3) as peak_hour, round(st, 4) as cri, round(kelvin, 0) as cct, {_RGB} as rgb from (select *, ni + (da - ni) * sh as kelvin, (ni + (da - ni) * sh) / 100 as t from ({_LIGHT.format(strength="cri")}))""",
    "light_ceiling": f"""select patient_id, cast(i as int) as step, round(fl + (1 - fl) * sh, 4) as intensity, round(st, 4) as strength from ({_LIGHT.format(strength="cri, r2")})""",
    "night_intervals": f"""select {_K}, n * 1000 as night_start, n * 1000 + 43200000 as night_end from (select {_K}, min(hr) * 3600 as a, (max(hr) + 1) * 3600 as b from h group by all), unnest(range(a // 86400 * 86400 + 64800 - case when a % 86400 < 64800 then 86400 else 0 end, b, 86400)) q(n)""",
    "q8_patients": "select distinct patient_id from h",
    "q9_signals": "select distinct signal_type from h",
    "q10_panel": f"select signal_type, {_H}, {_r('median')} from h where patient_id = 'P0001' and hr * 3600000 between epoch_ms(timestamp '2024-01-05') and epoch_ms(timestamp '2024-01-12')",
    "q11_amplitude": f"select {_K}, {_E}, {_r('amplitude')} from fit where e * 3600000 between 1704412800000 and 1705017600000",
    "q12_index": f"select {_K}, {_E}, {_r('cri')} from cwt where e * 3600000 between 1704412800000 and 1705017600000",
    "q13_fit": f"select {_K}, {_E}, {_r('r2')} from fit where e * 3600000 between 1704412800000 and 1705017600000",
    "q14_stability": f"select {_K}, {_E}, {_r('is_stability', 'iv_variab')} from iv where e * 3600000 between 1704412800000 and 1705017600000",
    "q15_latest": f"select {_K}, {_E}, cast(round(cast(amplitude as decimal(38,18)), 2) as double) as amplitude, cast(round(cast(r2 as decimal(38,18)), 3) as double) as r2 from fit qualify row_number() over (partition by {_K} order by e desc) = 1",
    "q16_disruptions": "select * from ev",
    "q17_phase": "select patient_id, round(acrophase + 1e-9, 4) as acrophase, round(r2 + 1e-9, 4) as r2 from fit where signal_type = 'view' qualify row_number() over (partition by patient_id order by e desc) = 1",
    "q18_index": "select patient_id, round(cri + 1e-9, 4) as cri from lat where signal_type = 'view' and cri is not null",
    "q19_status": f"""select {_K}, case when na is null and fit is null then 'none' when fit < 0.3 then 'crit' when decline >= 0.65 then 'crit' when decline >= 0.4 or fit < 0.5 then 'warn' else 'good' end as level,
 case when na is null and fit is null then 'No rhythm metrics' when fit < 0.3 then 'Rhythm disrupted' when decline >= 0.65 then 'Rhythm disrupted' when decline >= 0.4 then 'Rhythm weakened' when fit < 0.5 then 'Rhythm weak' else 'Rhythm preserved' end as label, {_r('fit', 'decline')}
 from (select {_K}, na, coalesce(r2, cri) as fit, case when na >= 8 then case when base > 0 then 1 - cur / base else 0 end end as decline from lat left join
 (select {_K}, max(m) as na, list_sort(list(amplitude) filter (i <= greatest(3, m // 3)))[max(greatest(3, m // 3)) // 2 + 1] as base, list_sort(list(amplitude) filter (i > m - greatest(3, m // 6)))[max(greatest(3, m // 6)) // 2 + 1] as cur
 from (select *, row_number() over (partition by {_K} order by e) as i, count(*) over (partition by {_K}) as m from fit where amplitude is not null) group by all) using (patient_id, signal_type))""",
    "q20_tiles": f"select {_K}, {_r('amplitude', 'r2', 'cri', 'is_stability', 'iv_variab')}, round(((-acrophase * 24 / (2 * pi())) % 24 + 24) % 24, 2) as peak_hour, span_days from lat join (select {_K}, round((max(hr) - min(hr)) / 24.0, 4) as span_days from h group by all) using (patient_id, signal_type) where amplitude is not null",
    "overlay": f"select {_K}, event_type, {_E}, {_r('amplitude')} from fit join ev using (patient_id, signal_type) where e * 3600000 >= start_time and e * 3600000 < end_time",
    "shaded": f"select {_K}, case when hr % 24 >= 18 or hr % 24 < 6 then 'night' else 'day' end as part, count(*) as n, round(avg(median) + 1e-9, 4) as mean from h group by all",
    "truth_effects": f"""select {_K}, cast(hh as double) as h, round(product(case type when 'amplitude_drop' then 1 - p * (1 - m) when 'fragmentation' then 1 - 0.5 * p * m else 1 end), 4) as factor, round(sum(case type when 'phase_shift' then -p * 2 * pi() * m / 24 else 0 end), 4) as phase, round(sum(case type when 'fragmentation' then p * 8 * m * sign(sin(2 * pi() * hh / bout)) else 0 end), 4) as added
 from (select *, case when ramp <= 0 then 1.0 when hh < a + ramp then (hh - a) / ramp when hh > z - ramp then (z - hh) / ramp else 1.0 end as p from truth, (select unnest(range(0, 720)) as hh) where hh >= a and hh < z) group by {_K}, hh""",
    "upsert": "select patient_id, signal_type, day, n, case when signal_type = 'view' then top + 1 else top end as top from (select patient_id, signal_type, strftime(epoch_ms(t), '%Y-%m-%d') as day, count(*) as n, round(max(value), 4) as top from s group by all union all select patient_id, 'tap', strftime(epoch_ms(t), '%Y-%m-%d'), count(*), round(max(value), 4) from s where signal_type = 'click' group by all)",
    "insert_absent": "select distinct patient_id, signal_type from s where signal_type = 'view'",
    "stream_metrics": f"select {_K}, method, {_E}, {_r('mesor', 'amplitude', 'r2', 'cri', 'is_stability', 'iv_variab')} from met, (select max(t) - 5000 as mark from s) where e * 3600000 <= mark",
    "golden_spectra": "select period, " + ", ".join(f"round(max(power) filter (signal_type = '{n}'), 3) as {n}" for n, *_ in EVENT_SIGNALS) + " from (select *, max(e) over (partition by signal_type) as l from spec where patient_id = 'P0001') where e = l group by period",
    "stream_tumbling": f"select {_K}, {_H}, n, {_r('median', 'sd', 'completeness')} from h where (hr + 1) * 3600000 <= (select max(t) - 5000 from s)",
}

_OTHER = {
    "device_dispositions": _DEVICE_CTE + "select disposition, count(*) as n, cast(sum(ms) as bigint) as times from d group by 1",
    "unmapped_labels": _DEVICE_CTE + "select coalesce(label, '(blank)') as raw_label, count(*) as n from d where disposition = 'unmapped' group by 1",
    "normal_ranges": "select signal_type, cast(lo as double) as low, cast(hi as double) as high from (values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in NORMAL_RANGES) + ") v(signal_type, lo, hi)",
    "period_grid": "select cast(j as int) as j, round(2.0 * 2 ** (j / 8.0), 6) as period from (select unnest(range(0, 37)) as j)",
    "colours": "select kelvin, " + ", ".join(f"round(greatest(0, least(255, {c})), 3) as {n}" for c, n in zip(_CHANNELS, ("red", "green", "blue"))) + ", " + ", ".join(f"round(greatest(0, least(255, {c.replace('(t ', '(u ').replace('ln(t)', 'ln(u)').replace('when t ', 'when u ')})), 3) as {n}" for c, n in zip(_CHANNELS, ("free_red", "free_green", "free_blue"))) + " from (select 800.0::double + i * 250 as kelvin, greatest(1000, least(40000, 800.0::double + i * 250)) / 100 as t, (800.0::double + i * 250) / 100 as u from (select unnest(range(0, 50)) as i))",
    "scalar_functions": "select event_id, upper(event_type) || 'X9' as label, greatest(10.0::double, least(50.0::double, value)) as clamped, round(2 + 3 * (value / 100), 4) as lerped, ((cast(round(value, 0) as bigint) - 100) % 24 + 24) % 24 as modulo, cast(floor(value + 0.5) as bigint) as half_up, epoch_us(ts) // 3600000000 * 3600000 as hop, "
    "printf('%02d:%02d', cast(floor((value % 24) * 60 + 0.5) as bigint) % 1440 // 60, cast(floor((value % 24) * 60 + 0.5) as bigint) % 60) as hhmm, printf('%02x', cast(greatest(0, least(255, floor(value + 0.5))) as int)) as hex, '&lt;a&amp;b&gt;' || event_type as html, printf('P%04d', user_id) as name, printf('%.2f', value) as fixed, user_id * 1000003 + event_id * 9176 + 2 * 131 + 7 as seed, cast(round_even(value / 7, 0) as bigint) as rint, cast(sign(value - 20) as int) as sign, 'a b' as words from events",
}


def oracle_sql() -> dict[str, str]:
    return {k: _CTE + v for k, v in _BODIES.items()} | _OTHER
