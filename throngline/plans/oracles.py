"""DuckDB SQL for the named queries, written from the rules and not from the Spark code."""

from __future__ import annotations

_DET = """n as (select count(*)::double n from events),
det0 as (select event_id, event_type, value, date_diff('day', date '2024-01-01', cast(ts as date)) * 24 + hour(ts) frame from events),
det as (select event_id, event_type, value, frame::bigint frame, 1000e0 + frame t, (event_id * 37 % 960) + 5e-1 x, (event_id * 91 % 544) + 5e-1 y,
  abs(frame % 120 - 60) / 6e1 demand, (4e-1 + 16e-1 * abs(frame % 120 - 60) / 6e1) * (22e-1 * 510 * 720 / n) mass from det0, n)"""
_FLOW = """samp as (select event_id, frame, t, x, y, value, mass, least(value, 2e2) * least(value, 2e2) w, v * sin(th) dx, -v * cos(th) dy from (select *,
  radians((case when y < 256 then 180e0 else 0e0 end) + 24e0 * (case event_type when 'click' then -2 when 'error' then -1 when 'purchase' then 0 when 'signup' then 1 else 2 end)) th,
  32e0 * (75e-2 + least(value, 2e2) / 8e2) * (12e-1 - demand) v from det)),
still as (select *, w < 2e-2 * max(w) over (partition by frame) st from samp),
shake as (select frame, avg(st::int) share, quantile_cont(dx, 0.5) filter (st) mx, quantile_cont(dy, 0.5) filter (st) my from still group by frame),
calm as (select s.* replace (dx - case when share >= 0.15 then coalesce(mx, 0e0) else 0e0 end as dx, dy - case when share >= 0.15 then coalesce(my, 0e0) else 0e0 end as dy) from still s join shake using (frame))"""
# the slanted view: a point (x, y) stands at (x, y) / 32 / (1 + y / 1088); a region is made of boxes, whose images are trapezia
_ZONES = """pieces(zone_id, name, ordinal, kind, x0, y0, x1, y1, cx, cy) as (values ('ghat_west', 'West steps', 0, 'zone', 0e0, 0e0, 448e0, 192e0, 224e0, 96e0), ('ghat_east', 'East steps', 1, 'zone', 448e0, 0e0, 960e0, 192e0, 704e0, 96e0),
  ('gate_approach', 'Main gate approach', 2, 'zone', 496e0, 192e0, 848e0, 307e0, 672e0, 2495e-1), ('west_approach', 'West gate approach', 3, 'zone', 32e0, 192e0, 320e0, 307e0, 176e0, 2495e-1),
  ('exit_apron', 'Exit apron', 4, 'zone', 0e0, 320e0, 960e0, 432e0, 480e0, 432e0), ('exit_apron', 'Exit apron', 4, 'zone', 480e0, 432e0, 960e0, 544e0, 480e0, 432e0),
  ('main_gate', 'Main gate', 5, 'corridor', 624e0, 272e0, 720e0, 352e0, 672e0, 312e0), ('west_corridor', 'West corridor', 6, 'corridor', 120e0, 272e0, 200e0, 352e0, 160e0, 312e0)),
areas as (select zone_id, name, ordinal, kind, cx, cy, sum((x1 - x0) / 32 * (1 / (1 + y0 / 1088) + 1 / (1 + y1 / 1088)) / 2 * (y1 / (1 + y1 / 1088) - y0 / (1 + y0 / 1088)) / 32) area from pieces group by all)"""
_OBS = """frames as (select distinct frame from det),
memb as (select s.*, zone_id, (x + dx) / 32 / (1 + (y + dy) / 1088) - x / 32 / (1 + y / 1088) vx, (y + dy) / 32 / (1 + (y + dy) / 1088) - y / 32 / (1 + y / 1088) vy
  from calm s join pieces z on s.x > x0 and s.x < x1 and s.y > y0 and s.y < y1),
zm as (select f.frame, a.zone_id, kind, coalesce(k, 0) samples, coalesce(m, 0e0) cnt, coalesce(m, 0e0) / area density
  from frames f cross join areas a left join (select frame, zone_id, count(*) k, sum(mass) m from memb group by all) g on g.frame = f.frame and g.zone_id = a.zone_id),
sums as (select frame, zone_id, sum(w) w, sum(w * sqrt(vx * vx + vy * vy)) / sum(w) speed, sum(w * vx) / sum(w) ux, sum(w * vy) / sum(w) uy, sum(w * dx) / sum(w) px, sum(w * dy) / sum(w) py, sum(w * (vx * vx + vy * vy)) / sum(w) v2 from memb group by all having sum(w) > 1e-9),
zf as (select f.frame, a.zone_id, kind, coalesce(speed, 0e0) speed, coalesce(greatest(v2 - (ux * ux + uy * uy), 0e0), 0e0) variance,
  case when sqrt(px * px + py * py) > 25e-2 and speed > 5e-2 then (degrees(atan2(px, -py)) + 360e0) % 360e0 end heading,
  case when speed > 1e-6 then least(1e0, sqrt(ux * ux + uy * uy) / speed) else 0e0 end coherence
  from frames f cross join areas a left join sums s on s.frame = f.frame and s.zone_id = a.zone_id),
zs0 as (select frame, zone_id, kind, quantile_cont(speed, 0.5) over w speed, quantile_cont(variance, 0.5) over w variance,
  quantile_cont(sin(radians(heading)), 0.5) over w sn, quantile_cont(cos(radians(heading)), 0.5) over w cs from zf window w as (partition by zone_id order by frame rows between 4 preceding and current row)),
zs as (select *, case when sqrt(sn * sn + cs * cs) > 1e-9 then (degrees(atan2(sn, cs)) + 360e0) % 360e0 end heading from zs0),
obs as (select zm.zone_id, zm.frame, 1000e0 + zm.frame t, density, cnt, speed, heading, variance from zm join zs using (frame, zone_id) where zm.kind = 'zone')"""
_RISK = """sm as (select *, avg(density) over (partition by zone_id order by t rows between 2 preceding and current row) d3, quantile_cont(speed, 0.75) over r baseline, count(*) over r nw, t - min(t) over r span
  from obs window r as (partition by zone_id order by t range between 60 preceding and current row)),
win as (select a.zone_id, a.frame, b.t, b.d3, row_number() over (partition by a.zone_id, a.frame order by b.t) rn from sm a join sm b on a.zone_id = b.zone_id and b.t between a.t - 60 and a.t),
sl as (select zone_id, frame, regr_slope(d3, t) * 60 rate from win where rn >= 3 group by all),
rr as (select sm.*, case when nw < 4 or span < 5 then 0e0 else coalesce(rate, 0e0) end rate from sm left join sl using (zone_id, frame)),
edges(zone_id, nb, ord) as (values ('ghat_west', 'north_bank', 0), ('ghat_west', 'ghat_east', 1), ('ghat_west', 'west_approach', 2), ('ghat_east', 'ghat_west', 0), ('ghat_east', 'gate_approach', 1), ('gate_approach', 'ghat_east', 0),
  ('gate_approach', 'exit_apron', 1), ('gate_approach', 'west_approach', 2), ('west_approach', 'ghat_west', 0), ('west_approach', 'exit_apron', 1), ('west_approach', 'gate_approach', 2), ('exit_apron', 'gate_approach', 0), ('exit_apron', 'west_approach', 1)),
cv0 as (select a.zone_id, a.frame, nb, ord, round(greatest(0e0, -cos(radians(a.heading - b.heading))) * least(1e0, least(a.density, b.density) / 3), 9) s from obs a join edges e on e.zone_id = a.zone_id
  join obs b on b.zone_id = nb and b.frame = a.frame where a.heading is not null and b.heading is not null and a.speed >= 1e-1 and b.speed >= 1e-1),
cv as (select zone_id, frame, s convergence, nb against from cv0 where s > 0 qualify row_number() over (partition by zone_id, frame order by s desc, ord) = 1),
sg0 as (select rr.*, coalesce(convergence, 0e0) convergence, against, density * variance pressure, case when baseline > 5e-2 then greatest(0e0, (baseline - speed) / baseline) else 0e0 end drp,
  case when density >= 5 then 0e0 when rate >= 12e-2 then least((5 - density) / (rate / 60), 36e2) end ttc from rr left join cv using (zone_id, frame)),
sg as (select *, case when density >= 4 then 2 when density >= 3 then 1 else 0 end l_density, case when rate >= 12e-2 and ttc <= 120 then 2 when rate >= 12e-2 and ttc <= 300 then 1 else 0 end l_density_trend,
  case when not (density >= 2 or (rate >= 12e-2 and density >= 8e-1)) then 0 when (speed <= 35e-2 or drp >= 35e-2 * 16e-1) and density >= 3 then 2
    when (drp >= 35e-2 and speed < 1) or (speed <= 35e-2 and density >= 2) then 1 else 0 end l_flow_breakdown,
  case when pressure >= 12e-1 then 2 when pressure >= 6e-1 then 1 else 0 end l_pressure, case when convergence >= 7e-1 then 2 when convergence >= 45e-2 then 1 else 0 end l_convergence from sg0),
as0 as (select *, greatest(l_density, l_density_trend, l_flow_breakdown, l_pressure, l_convergence) lvl from sg),
ass as (select *, ['green', 'amber', 'red'][lvl + 1] risk, case when lvl = 0 then '' when l_flow_breakdown = lvl then 'flow_breakdown' when l_density_trend = lvl then 'density_trend' when l_convergence = lvl then 'convergence'
    when l_pressure = lvl then 'pressure' else 'density' end headline,
  case when density >= 5 then 'critical' when density >= 4 then 'very_crowded' when density >= 3 then 'crowded' when density >= 2 then 'busy' else 'free' end band,
  case when rate >= 12e-2 then 'rising' when rate <= -12e-2 then 'falling' else 'steady' end trend from as0),
txt as (select ass.*, printf('%.2f p/m2 (%s)', density, replace(band, '_', ' ')) t0,
  case when rate >= 12e-2 then printf('rising %+.2f p/m2/min', rate) || case when ttc is not null then printf(', %.0f min to critical', round_even(ttc / 60, 0)) else '' end when rate <= -12e-2 then printf('falling %+.2f p/m2/min', rate) else 'steady' end t1,
  case when l_flow_breakdown = 0 then printf('%.2f m/s, flowing', speed) else printf('%.2f m/s, down %.0f%% from %.2f at %.1f p/m2', speed, drp * 100, baseline, density) end t2,
  case when l_convergence = 0 then 'no opposing flow' else printf('opposing flow with %s (%.2f)', n.name, convergence) end t3,
  printf('index %.2f (density %.1f x variance %.2f)', pressure, density, variance) t4 from ass left join areas n on n.zone_id = against)"""
_FSM = """rk as materialized (select zone_id z, row_number() over (partition by zone_id order by frame) f, t, lvl, headline h, case headline when 'density' then 'High density - ' || t0 when 'flow_breakdown' then 'Movement breaking down - ' || t2 when 'convergence' then 'Opposing flows meeting - ' || t3 when 'pressure' then 'Turbulent movement - ' || t4
    when 'density_trend' then 'Density rising - ' || case when round(ttc, 1) >= 60 then round_even(round(ttc, 1) / 60, 0)::int || ' min' else round_even(round(ttc, 1), 0)::int || ' s' end || ' to critical' end msg from txt),
fsm as (select z, min(f) - 1 f, 0e0 t, null::double p, null::int a, null::double c, null::double l, null::varchar kind, null::double fs, 0 esc, 0 ep, ''::varchar h, ''::varchar msg from rk group by z
  union all
  select z, f, t, case when lvl = 0 or kind in ('fired', 'escalated') or (a is not null and lvl <= a) then null else coalesce(p, t) end,
    case when kind = 'resolved' then null when kind is not null then lvl else a end, case when lvl > 0 or kind = 'resolved' then null when a is not null then coalesce(c, t) end,
    case when kind = 'resolved' then t else l end, kind, case when kind = 'fired' then p else fs end, case kind when 'fired' then 0 when 'escalated' then esc + 1 else esc end, case when kind = 'fired' then ep + 1 else ep end, h, msg
  from (select s.z, r.f, r.t, r.lvl, r.h, r.msg, s.p, s.a, s.c, s.l, s.fs, s.esc, s.ep, case
      when r.lvl = 0 and s.a is not null and r.t - s.c >= 45 then 'resolved'
      when r.lvl > 0 and s.a is not null and r.lvl > s.a and r.t - s.p >= 10 then 'escalated'
      when r.lvl > 0 and s.a is null and r.t - s.p >= 25 and not (s.l is not null and r.t - s.l < 120 and r.lvl < 2) then 'fired' end kind
    from fsm s join rk r on r.z = s.z and r.f = s.f + 1)),
ev as (select z zone_id, t, kind, fs first_seen, esc, ep, h headline, msg, max(case when kind <> 'resolved' then t end) over (partition by z order by f) cht, a, f from fsm where kind is not null),
sev as (select *, case when kind = 'resolved' then lag(a) over (partition by zone_id order by f) else a end sv from ev),
num as (select zone_id, ep, row_number() over (order by t, ordinal) seq from sev join (select distinct zone_id, ordinal from areas) using (zone_id) where kind = 'fired'),
cur as (select 'a' || seq alert_id, seq, s.zone_id, min(first_seen) first_seen, ['green', 'amber', 'red'][arg_max(sv, t) filter (kind <> 'resolved') + 1] severity, arg_max(headline, t) filter (kind <> 'resolved') metric, arg_max(msg, t) filter (kind <> 'resolved') message,
  max(t) filter (kind <> 'resolved') ts, max(esc) escalations, max(t) filter (kind = 'resolved') resolved_at, case when max(t) filter (kind = 'resolved') is null then 'active' else 'resolved' end state
  from sev s join num using (zone_id, ep) group by seq, s.zone_id)"""


# windows and smoothing inside epochs; an epoch's first frame has no movement
_EPOCH = """chg as (select 1000e0 + date_diff('day', date '2024-01-01', cast(ts as date)) * 24 + hour(ts) t, case when day(ts) = 1 then 'reset' else 'scene' end cause from events where event_type = 'error'
  qualify row_number() over (partition by cast(ts as date) order by value desc, event_id desc) = 1),
ep as (select frame, (select count(*) from chg c where c.t <= 1000e0 + frame) epoch, (select arg_max(cause, t) from chg c where c.t <= 1000e0 + frame) cause from frames),
eo as (select *, row_number() over (partition by epoch order by frame) = 1 opens from ep),
e0 as (select zone_id, frame, epoch, cause, opens, case when opens then 0e0 else quantile_cont(v, 0.5) over w end speed from (select *, case when opens then 0e0 else speed end v from zf join eo using (frame) where kind = 'zone')
  window w as (partition by zone_id, epoch order by frame rows between 4 preceding and current row)),
eb as (select e0.*, 1000e0 + e0.frame t, density from e0 join zm using (frame, zone_id)),
em as (select *, avg(density) over (partition by zone_id, epoch order by t rows between 2 preceding and current row) d3, quantile_cont(speed, 0.75) over r baseline, count(*) over r nw, t - min(t) over r span
  from eb window r as (partition by zone_id, epoch order by t range between 60 preceding and current row)),
el as (select a.zone_id, a.frame, regr_slope(b.d3, b.t) * 60 rate from em a join (select *, row_number() over (partition by zone_id, epoch order by t) i from em) b
  on a.zone_id = b.zone_id and a.epoch = b.epoch and b.t between a.t - 60 and a.t and b.i >= 2 + (select min(c.i) from (select zone_id, epoch, t, row_number() over (partition by zone_id, epoch order by t) i from em) c where c.zone_id = a.zone_id and c.epoch = a.epoch and c.t >= a.t - 60) group by all),
er as (select em.*, case when nw < 4 or span < 5 then 0e0 else coalesce(rate, 0e0) end rate from em left join el using (zone_id, frame)),
ef as (select *, case when density >= 5 then 0e0 when rate >= 12e-2 then least((5 - density) / (rate / 60), 36e2) end ttc,
  case when density >= 5 then 'critical' when density >= 4 then 'very_crowded' when density >= 3 then 'crowded' when density >= 2 then 'busy' else 'free' end band from er)"""


def _q(select: str, *parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


_O, _A = (_DET, _FLOW, _ZONES, _OBS), (_DET, _FLOW, _ZONES, _OBS, _RISK)
_ALERT = lambda select: _q(select, *_A, _FSM, recursive=True)
# The suggested actions.
_ACTION = "case headline when 'density' then 'Hold inflow at the upstream barrier until density falls.' when 'density_trend' then 'Slow inflow now -- acting after the threshold is crossed is too late.' when 'flow_breakdown' then 'Movement is stalling. Stop inflow and open the nearest corridor.' when 'convergence' then 'Opposing streams meeting. Separate the flows before they lock.' when 'pressure' then 'Turbulent movement. Get eyes on this zone and prepare to hold inflow.' else '' end"
_AGENTS = """ag as (select frame // 24 frame, event_id id, x / 32 x, y / 32 y from det),
ld as (select a.frame, a.id, count(*) / pi() density, 125e-2 * greatest(0, least(1, 1 - count(*) / pi() / 6)) speed from ag a join ag b on a.frame = b.frame and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1 group by a.frame, a.id)"""
_QUICK = _FSM.replace(">= 45", ">= 4").replace(">= 25", ">= 5").replace(">= 10 ", ">= 2 ").replace("< 120", "< 12")
_CAPTURES = """kf as (select arg_max(date_diff('day', date '2024-01-01', cast(ts as date)) * 24 + hour(ts), (ts, event_id))::bigint frame from events group by floor(epoch(ts) / 21600)),
cap as (select 'a' || seq alert_id, s.t, (select max(k.frame) from kf k where 1000e0 + k.frame <= s.t) frame from sev s join num using (zone_id, ep) where kind <> 'resolved')"""
_PHASES = "ph(until_s, start_s, inflow, west_share, label) as (values (40e0, 0e0, 12e-1, 1e-1, 'calm'), (100e0, 40e0, 38e-1, 1e-1, 'procession arriving'), (200e0, 100e0, 52e-1, 8e-2, 'gate saturating'), (265e0, 200e0, 2e0, 7e-1, 'west corridor opened'), (330e0, 265e0, 0e0, 6e-1, 'clearing'), (1e9, 330e0, 0e0, 6e-1, 'recovered'))"

# the blur has a width of nine cells (sigma 3); cells beyond an edge are the mirrored ones inside
_FIELD = """w as (select o, exp(-o * o / 18e0) / (select sum(exp(-p * p / 18e0)) from (select unnest(range(-4, 5)) p)) k from (select unnest(range(-4, 5)) o)),
cm as (select frame, floor(x / 32)::bigint cx, floor(y / 32)::bigint cy, sum(mass) m from det group by all),
tx as (select cx, o, case when cx + o < 0 then -(cx + o) when cx + o > 29 then 58 - (cx + o) else cx + o end src, k from (select unnest(range(30)) cx), w),
ty as (select cy, o, case when cy + o < 0 then -(cy + o) when cy + o > 16 then 32 - (cy + o) else cy + o end src, k from (select unnest(range(17)) cy), w),
bx as (select frame, tx.cx, cm.cy, sum(m * k) m from cm join tx on tx.src = cm.cx group by all),
by_ as (select frame, bx.cx, ty.cy, sum(m * k) m from bx join ty on ty.src = bx.cy group by all),
ca as (select y // 32 cy, sum(32 / 1024e0 / (1 + (y + 5e-1) / 1088) ** 3) area from (select unnest(range(544)) y) group by all),
field as (select frame, cx, cy, m / area density from by_ join ca using (cy))"""

_LUT = """with st(i, d, b, g, r) as (values (1, 0e0, 150, 200, 120), (2, 2e0, 120, 220, 235), (3, 3e0, 60, 170, 250), (4, 4e0, 55, 75, 240), (5, 5e0, 90, 40, 170), (6, 7e0, 120, 30, 120)),
        x as (select idx::int idx, idx * 7e0 / 255 d from (select unnest(range(256)) idx))
        select idx, round(x.d, 6) density, floor(a.b + (z.b - a.b) * (x.d - a.d) / (z.d - a.d) + 1e-9)::int b, floor(a.g + (z.g - a.g) * (x.d - a.d) / (z.d - a.d) + 1e-9)::int g, floor(a.r + (z.r - a.r) * (x.d - a.d) / (z.d - a.d) + 1e-9)::int r,
        case when idx = 0 then 0 else floor(least(235, least(1, x.d / 18e-1) * 165 + greatest(0, least(1, (x.d - 18e-1) / 25e-1)) * 70) + 1e-9)::int end a
        from x join st a on true join st z on z.i = a.i + 1 and x.d >= a.d and (x.d < z.d or (z.i = 6 and x.d >= z.d - 1e-9))"""
# the opened mask of the gray grids
_MASK = """g0 as (select frame, floor(x / 48)::bigint cx, floor(y / 48)::bigint cy, count(*) n from det group by all),
        g as (select f.frame, f.cx, f.cy, 120e0 - (f.cx * 37 + f.cy * 53 + f.frame * 29) % 60 - coalesce(n, 0) * 15 gray from (select * from (select distinct frame from det), (select unnest(range(20)) cx), (select unnest(range(12)) cy)) f left join g0 using (frame, cx, cy)),
        dark as (select frame, cx, cy from (select *, quantile_cont(gray, 0.5) over (partition by frame) md from g) where gray < md - 12),
        open as (select * from dark d where (cx = 0 or exists (from dark e where e.frame = d.frame and e.cx = d.cx - 1 and e.cy = d.cy)) and (cy = 0 or exists (from dark e where e.frame = d.frame and e.cx = d.cx and e.cy = d.cy - 1))
          and (cx = 0 or cy = 0 or exists (from dark e where e.frame = d.frame and e.cx = d.cx - 1 and e.cy = d.cy - 1))),
        masked as materialized (select distinct frame, cx + i cx, cy + j cy from open join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) on cx + i <= 19 and cy + j <= 11)"""

ORACLES = {
    "detections": _q("select event_id, frame, t, x, y, round(mass, 6) mass from det", _DET),
    "flow_samples": _q("select event_id, frame, x, y, round(w, 6) weight, round(dx, 6) dx, round(dy, 6) dy from samp", _DET, _FLOW),
    "sampled_latest_per_bucket": "select arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type, arg_max(value, (ts, event_id)) as value, count(*) seen from events group by floor(epoch(ts) / 3600)",
    "region_geometry": _q("select zone_id id, kind, ordinal, round(area, 6) area_m2, round(1 / area, 6) m2_per_person, cx, cy from areas", _ZONES),
    "pixel_area_profile": "select y, round(960 / 1024e0 / (1 + (y + 5e-1) / 1088) ** 3, 6) area_m2, 960::bigint pixels from (select unnest(range(544)) y)",
    "unknown_neighbours": "select * from (values ('ghat_west', 'north_bank')) v(zone_id, neighbor_id)",
    "zone_membership": _q("select zone_id, count(*) n, min(event_id) first_event, max(event_id) last_event from det join pieces on x > x0 and x < x1 and y > y0 and y < y1 group by all", _DET, _ZONES),
    "zone_density": _q("select frame, zone_id, samples, round(cnt, 6) count, round(density, 6) density from zm where kind = 'zone'", *_O),
    "density_regrid": _q("select frame, floor(x / 32)::bigint cx, floor(y / 32)::bigint cy, round(sum(mass), 6) mass from det group by all", _DET),
    "heat_cells": _q(f"select frame, cx, cy, round(density, 6) density, idx, b, g, r, a from (select frame, cx, cy, density, least(255, greatest(0, floor(density / 7 * 255)))::int idx from hc) join (select idx, b, g, r, a from ({_LUT})) using (idx)",
        _DET, "hc as (select frame, floor(x / 32)::bigint cx, floor(y / 32)::bigint cy, sum(mass) density from det group by all)"),
    "band_legend": "select * from (values (0, 'free', 0e0, 2e0), (1, 'busy', 2e0, 3e0), (2, 'crowded', 3e0, 4e0), (3, 'very_crowded', 4e0, 5e0), (4, 'critical', 5e0, null)) v(ord, band, low, high)",
    "heat_lut": _LUT,
    "detection_splat": _q("""select frame, round(sum(m), 6) mass, count(*) pixels, round(sum(m * x), 6) moment_x from (select frame, x, y, sum(g / tot) m from (
        select *, sum(g) over (partition by event_id) tot from (select *, exp(-((x - ix) ** 2 + (y - iy) ** 2) / (2 * s * s)) g from (
        select *, unnest(range(greatest(iy - r, 0), least(iy + r, 543) + 1)) y from (select *, unnest(range(greatest(ix - r, 0), least(ix + r, 959) + 1)) x from (
        select event_id, frame, floor(x)::bigint ix, floor(y)::bigint iy, greatest(2e0, least(8 + event_id % 24, 8 + event_id % 17) / 4e0) s, floor(3 * greatest(2e0, least(8 + event_id % 24, 8 + event_id % 17) / 4e0))::bigint r from det))))) group by all) group by frame""", _DET),
    "blob_components": _q("""select frame, label.x label_x, label.y label_y, count(*) cells, sum(pixels) pixels, greatest(1e0, sum(pixels) / 2) people from (select c.frame, c.cx, c.cy, c.pixels, min(r.root) label from c join r on r.frame = c.frame and r.cx = c.cx and r.cy = c.cy group by all) group by all""",
        _DET, "c as materialized (select frame, floor(x / 48)::bigint cx, floor(y / 48)::bigint cy, count(*)::double pixels from det group by all)",
        "r as (select frame, cx, cy, {'x': cx, 'y': cy} root from c union select c.frame, c.cx, c.cy, r.root from r join c on c.frame = r.frame and abs(c.cx - r.cx) <= 1 and abs(c.cy - r.cy) <= 1)", recursive=True),
    "dark_mask": _q("select frame, cx, cy from masked", _DET, _MASK),
    "blob_density": _q("select frame, cx, cy, label.x label_x, label.y label_y, round(greatest(1e0, count(*) over (partition by frame, label) / 3e0) / count(*) over (partition by frame, label), 6) mass from (select frame, cx, cy, min(root) label from r group by all)",
        _DET, _MASK, "r as (select frame, cx, cy, {'x': cx, 'y': cy} root from masked union select c.frame, c.cx, c.cy, r.root from r join masked c on c.frame = r.frame and abs(c.cx - r.cx) <= 1 and abs(c.cy - r.cy) <= 1)", recursive=True),
    "density_field": _q("select frame, cx, cy, round(density, 6) density from field", _DET, _FIELD),
    "heat_published": _q("select frame, round(heat_max, 6) heat_max, least(255, greatest(0, floor(heat_max / 7 * 255)))::int idx from hp join pk using (frame)",
        _DET, _FIELD, "pk as materialized (select frame, max(density) heat_max from field group by frame)", "hp as (select min(frame) frame from pk union all select min(pk.frame) from hp join pk on pk.frame >= hp.frame + 5 group by hp.frame)", recursive=True),
    "alert_counts": _ALERT("select severity, (select count(*) from cur where state = 'active' and cur.severity = s.severity) active from (values ('green'), ('amber'), ('red')) s(severity)"),
    "announced_once": _q("select 'a' || seq alert_id, zone_id, ['green', 'amber', 'red'][sv + 1] severity, min(t) t from sev join num using (zone_id, ep) where kind <> 'resolved' group by all", *_A,
        _FSM.replace(">= 45", ">= 4").replace(">= 25", ">= 5").replace(">= 10 ", ">= 2 ").replace("< 120", "< 12"), recursive=True),
    "flow_jitter_removed": _q("""select frame, count(*) n, count(*) filter (st) n_static, round(max(case when share >= 0.15 then coalesce(mx, 0e0) else 0e0 end), 6) jitter_x, round(max(case when share >= 0.15 then coalesce(my, 0e0) else 0e0 end), 6) jitter_y,
        round(avg(dx), 6) dx, round(avg(dy), 6) dy from calm join shake using (frame) group by frame""", _DET, _FLOW),
    "zone_flow": _q("select frame, zone_id, round(speed + 1e-9, 6) speed, round(variance, 6) variance, round(heading, 6) heading, round(coherence, 6) coherence from zf where kind = 'zone'", *_O),
    "observations": _q("select zone_id, frame, t, round(density, 6) density, round(cnt, 6) count, round(speed + 1e-9, 6) speed, round(heading, 6) heading, round(variance, 6) variance from obs", *_O),
    "density_slope": _q("select zone_id, frame, round(rate, 5) + 0e0 rate, round(baseline + 1e-9, 5) baseline, round(ttc, 5) ttc, band from ass", *_A),
    "scene_epochs": _q("select zone_id, frame, epoch, opens, cause, round(speed + 1e-9, 5) speed, round(rate, 5) + 0e0 rate, round(baseline + 1e-9, 5) baseline, round(ttc, 5) ttc, band from ef", *_O, _EPOCH),
    "risk_signals": _q("select zone_id, frame, round(drp, 5) as drop, round(pressure, 5) pressure, round(convergence, 5) convergence, against, l_flow_breakdown, l_density_trend, l_convergence, l_pressure, l_density from sg", *_A),
    "signals_long": _q("""select zone_id, frame, ord, name, ['green', 'amber', 'red'][lv + 1] as level, round(value, 3) + 0e0 as value, detail from (
        select zone_id, frame, unnest([0, 1, 2, 3, 4]) ord, unnest(['density', 'density_trend', 'flow_breakdown', 'convergence', 'pressure']) name, unnest([l_density, l_density_trend, l_flow_breakdown, l_convergence, l_pressure]) lv,
        unnest([round(density, 2), round(rate, 3), round(drp, 3), round(convergence, 3), round(pressure, 3)]) as value, unnest([t0, t1, t2, t3, t4]) detail from txt)""", *_A),
    "zone_states": _q("""select zone_id, name, frame, round(cnt + 1e-9, 1) count, round(area, 1) area_m2, round(density + 1e-9, 2) density, band, risk, trend, round(ttc + 1e-9, 1) ttc, round(speed + 1e-9, 2) speed, round(heading + 1e-9, 1) heading,
        round(variance + 1e-9, 3) variance, round(pressure + 1e-9, 3) pressure, headline from ass join (select zone_id, name, area from areas) n using (zone_id)""", *_A),
    "assess_scene": _q(f"select zone_id, frame, round(density, 6) density, risk, headline, band, trend, {_ACTION} as action from ass", *_A),
    "risk_changes": _q("select zone_id, frame, risk, headline from (select *, lag(risk || '/' || headline) over (partition by zone_id order by t) was from ass) where was is distinct from risk || '/' || headline", *_A),
    "latest_per_zone": _q("select zone_id, frame, round(density, 6) density, risk, headline from ass qualify row_number() over (partition by zone_id order by t desc) = 1", *_A),
    "zones_worst_first": _q("select zone_id, risk, round(density, 6) density from ass qualify row_number() over (partition by zone_id order by t desc) = 1", *_A),
    "corridor_status": _q("select frame, zone_id corridor_id, round(cnt, 6) count, round(density, 6) density, round(speed, 6) speed, case when density >= 2 or (density >= 1 and speed > 0 and speed < 35e-2) then 'blocked' when density >= 1 then 'restricted' else 'clear' end status from zm join zs using (frame, zone_id) where zm.kind = 'corridor'", *_O),
    "totals": _q("select frame, round(sum(round(cnt, 1)), 4) count, round(sum(round(area, 1)), 4) area_m2, round(sum(round(cnt, 1)) / sum(round(area, 1)), 4) density, count(*) filter (risk = 'amber') n_amber, count(*) filter (risk = 'red') n_red from ass join areas using (zone_id) group by frame", *_A),
    "count_error": _q("select frame, count(*) truth, round(sum(mass), 6) estimate, round(100 * (sum(mass) - count(*)) / count(*), 6) error_pct from det group by frame", _DET),
    "alert_events": _ALERT("select zone_id, t, kind, ['green', 'amber', 'red'][sv + 1] severity, headline, first_seen, esc escalations from sev"),
    "alert_events_quick": _q("select zone_id, t, kind, ['green', 'amber', 'red'][sv + 1] severity, headline, first_seen, esc escalations from sev", *_A,
        _FSM.replace(">= 45", ">= 4").replace(">= 25", ">= 5").replace(">= 10 ", ">= 2 ").replace("< 120", "< 12"), recursive=True),
    "alerts_current": _ALERT("select alert_id, seq, zone_id, severity, metric, message, state, ts, first_seen, escalations, resolved_at from cur"),
    "alerts_live": _ALERT("select alert_id, zone_id, severity, ts from cur where state = 'active'"),
    "alerts_recent": _ALERT("select alert_id, zone_id, severity, ts, state from cur order by ts desc, seq desc limit 10"),
    "alert_feed": _ALERT("select alert_id, zone_id, state, ts from cur order by state = 'active' desc, ts desc, seq desc limit 20"),
    "max_alert_seq": _ALERT("select coalesce(max(seq), 0) max_seq from cur"),
    "retention_purge": _ALERT("select count(*) filter (ts >= 1400) kept, count(*) filter (ts < 1400) purged from cur"),
    "audit_tail": "select event_id id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ts, event_type as action from events where event_type in ('error', 'purchase') order by id desc limit 50",
    "radius_neighbours": _q("select a.frame, a.id a, b.id b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) gap from ag a join ag b on a.frame = b.frame and a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1", _DET, _AGENTS),
    "local_density": _q("select frame, id, round(density, 6) density, round(speed, 6) speed from ld", _DET, _AGENTS),
    "speed_profile": _q("""select frame as day, count(*) n, round(avg(speed), 6) speed_mean, round(avg(density), 6) density_mean, count(*) filter (density >= 6) jammed, round(quantile_cont(speed, 0.5), 6) speed_p50, round(quantile_cont(speed, 0.9), 6) speed_p90, round(max(speed), 6) speed_max,
        round(quantile_cont(density, 0.5), 6) density_p50, round(quantile_cont(density, 0.95), 6) density_p95, round(max(density), 6) density_max from ld group by frame""", _DET, _AGENTS),
    "density_histogram": _q("select frame as day, case when density >= 8 then 17 else floor(density * 2)::int + 1 end bin, count(*) people from ld group by all", _DET, _AGENTS),
    "evidence_captured": _q("select alert_id, t, frame, case when frame is not null then '/frames/' || alert_id || '.jpg' end thumb from cap", *_A, _QUICK, _CAPTURES, recursive=True),
    "evidence_requests": _q("""select id, alert_id, t, status, case when status = 200 then frame end frame, case when status = 200 then '/frames/' || alert_id || '.jpg' end thumb from (
        select r.*, c.frame, case when not regexp_full_match(r.alert_id, 'a[0-9]+') then 400 when c.t is null or r.t - c.t > 240 then 404 else 200 end status from rq r asof left join (from cap where frame is not null) c on r.alert_id = c.alert_id and r.t >= c.t)""",
        *_A, _QUICK, _CAPTURES, "rq as (select event_id id, case when value < 5 then 'x' || event_id else 'a' || (event_id % 60) end alert_id, t from det where event_type = 'view')", recursive=True),
    "feed_status": _q("""select source, t, age, coalesce(age > 3, true) stale, case when coalesce(age > 3, true) then 'disconnected' else '' end banner from (select s.source, f.t, f.t - e.t age from (select distinct t from det) f cross join (select distinct event_type source from det) s
        asof left join (select distinct event_type source, t from det) e on e.source = s.source and f.t >= e.t)""", _DET),
    "scene_summary": _q("""select * from (select frame, count(*) zones, count(*) filter (risk <> 'green') not_green from ass group by frame)
        join (select frame, count(*) corridors, count(*) filter (density >= 1) not_clear from zm where kind = 'corridor' group by frame) using (frame)""", *_A),
    "flow_on_grid": _q("select frame, zone_id, round(speed + 1e-9, 6) speed, round(variance, 6) variance from zf where kind = 'zone'", _DET, _FLOW, _ZONES, _OBS.replace("from calm s join", "from (from calm where floor(x)::bigint % 8 = 0 and floor(y)::bigint % 8 = 0) s join")),
    "scenario_phase": _q("select event_id, label, inflow, west_share from events join ph on event_id % 400 >= start_s and event_id % 400 < until_s", _PHASES),
    "spawn_schedule": _q("select t, arrived, arrived - coalesce(lag(arrived) over (order by t), 0) spawned from (select t::double t, floor(sum(inflow * greatest(0, least(t, until_s) - start_s)) + 1e-9)::bigint arrived from (select unnest(range(1, 401)) t), ph group by t)", _PHASES),
    "truth_points": _q("select event_id, round(x / 32 / (1 + y / 1088), 6) gx, round(y / 32 / (1 + y / 1088), 6) gy from det", _DET),
    "fps_ewma": """with recursive s as (select event_type k, event_id::double t, row_number() over (partition by event_type order by event_id) rn, event_id - lag(event_id) over (partition by event_type order by event_id) dt from events),
        i as materialized (select *, case when dt > 1e-2 then 1e0 / dt else 0e0 end inst from s),
        e as (select k, t, rn, inst fps from i where rn = 1 union all select i.k, i.t, i.rn, case when e.fps = 0 then i.inst else e.fps + 2e-1 * (i.inst - e.fps) end from e join i on i.k = e.k and i.rn = e.rn + 1)
        select k as key, t, round(fps, 6) fps from e""",
}
