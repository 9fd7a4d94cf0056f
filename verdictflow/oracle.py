"""DuckDB SQL with the result of each query, over the same tables.

Every statement carries the views it needs as common table expressions.
"""

import re

RUN_DATE = "2024-03-01"
SEED = 7

# Spelled out here, apart from the package, so that a wrong spelling there shows.
FLAIR_SPELLINGS = {
    1.0: ["ASSHOLE", "YTA", "YOU'RE THE ASSHOLE"],
    0.0: ["NOT THE A-HOLE", "NOT THE ASSHOLE", "NTA"],
    2.0: ["EVERYONE SUCKS", "ESH", "EVERBODY SUCKS", "EVERYONE SUCKS HERE", "EVERYBODY SUCKS HERE"],
    3.0: ["NOT ENOUGH INFO", "NEI", "NOT ENOUGH INFO HERE"],
    4.0: ["NO A-HOLES HERE", "NAH", "NO A-HOLES"],
}
OUTCOME_NAMES = {0: "NTA", 1: "YTA", 2: "Everybody sucks", 3: "Not enough info", 4: "NAH"}
REMARKS = {
    "yta": [
        "The evidence was not on your side.",
        "An apology would be a good start.",
        "Perhaps sleep on it next time.",
    ],
    "nta": [
        "You may leave the room with your head up.",
        "Nothing to be sorry for.",
        "The case is dismissed.",
        "Carry on as you were.",
    ],
    "correct": ["One more for the record.", "The training was worth it.", "As expected."],
    "incorrect": ["Noted for the next training run.", "Even judges err."],
    "mistrial": ["Both sides go home without a ruling.", "The docket moves on."],
}


def _text(value):
    return "'" + value.replace("'", "''") + "'"


def _spellings(*codes):
    return ", ".join(_text(s) for code in codes for s in FLAIR_SPELLINGS[code])


def _outcome(flair):
    cases = " ".join(
        f"when upper({flair}) in ({_spellings(code)}) then {code}" for code in FLAIR_SPELLINGS
    )
    return f"cast(case {cases} end as double)"


def _name(code):
    cases = " ".join(f"when {code} = {value} then {_text(n)}" for value, n in OUTCOME_NAMES.items())
    return f"case {cases} end"


def _hash(value, digits):
    return f"cast('0x' || substr(md5({value}), 1, {digits}) as bigint)"


def _remark(verdict, key):
    cases = []
    for name, texts in REMARKS.items():
        options = ", ".join(_text(t) for t in texts)
        place = f"{_hash(f'{key} || {_text(f":{SEED}")}', 8)} % {len(texts)} + 1"
        cases.append(f"when {verdict} = '{name}' then [{options}][{place}]")
    return f"case {' '.join(cases)} end"


_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def _strip(value):
    return rf"regexp_replace({value}, '^{_BLANK}|{_BLANK}\z', '', 'g')"


def _short(value):
    text = _strip(value)
    head = rf"regexp_replace(substr({text}, 1, 100), ' [^ ]*\z', '')"
    return f"case when length({text}) <= 100 then {text} else {head} || '...' end"


def _message_id(run_date):
    return _hash(f"coalesce(title, '') || '|' || coalesce(url, '') || '|{run_date}'", 15)


def _quoted():
    short = _short("coalesce(title, '')")
    return f"""'"' || ({short}) || '"'"""


def _ruling():
    return (
        f"({_remark('lower(' + _name('pred') + ')', 'url')}) || ' Forecast for ' || {_quoted()} "
        f"|| ': ' || ({_name('pred')}) || ' (' || url || ')'"
    )


_GRADE = (
    "case when outcome > 1 then 'mistrial' when pred = outcome then 'correct' else 'incorrect' end"
)


def _update():
    return (
        f"{_quoted()} || ' closed as ' || ({_name('outcome')}) || '; forecast was ' || "
        f"({_name('pred')}) || '. ' || (case ({_GRADE}) "
        "when 'mistrial' then 'No forecasts are made for ' || outcome_str || ': not counted.' "
        "when 'correct' then 'Forecast met.' else 'Forecast missed.' end) || ' ' || "
        f"({_remark('(' + _GRADE + ')', 'url')}) || "
        "' https://example.org/message/' || cast(message_id as varchar)"
    )


_DECIDED = "link_flair_text is not null and link_flair_text <> ''"
_TWO = f"upper(link_flair_text) in ({_spellings(1.0, 0.0)})"
_POST_DATE = "date '1970-01-01' + cast(floor(created_utc / 86400) as int)"
_COMBINED = "coalesce(title, '') || ' ' || coalesce(selftext, '')"
_WORDS = r"list_filter(string_split_regex(lower(combined_text), '[^\p{L}]+'), lambda w: w <> '')"
_ACCURATE = "coalesce(cast(pred = outcome as int), 0)"
_RATES = """success / nullif(n, 0) as rate,
       sqrt((success / nullif(n, 0)) * (1 - success / nullif(n, 0))) as sd_prop,
       sqrt((success / nullif(n, 0)) * (1 - success / nullif(n, 0)) * n) as sd_n,
       sqrt((success / nullif(n, 0)) * (1 - success / nullif(n, 0)) / nullif(n, 0)) as se"""
_HISTORY = "date, outcome_type, success, n, rate, se, min_post_date, max_post_date"


VOCABULARY = 1 << 20


def _nibble(value):
    """CRC-32 of four bits."""
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _word_id(vocabulary):
    """SQL for the id of a word: the CRC-32 of its bytes, half a byte at a time, modulo the size."""
    digit = "instr('0123456789ABCDEF', {}) - 1"
    halves = (
        "flatten(list_transform(regexp_extract_all(hex(word), '..'), "
        f"lambda b: [({digit.format('b[2]')})::bigint, ({digit.format('b[1]')})::bigint]))"
    )
    crc = (
        f"list_reduce({halves}, lambda crc, x: "
        f"xor(crc >> 4, {[_nibble(i) for i in range(16)]}[xor(crc, x) % 16 + 1]), 4294967295::bigint)"
    )
    return f"cast(xor({crc}, 4294967295) % {vocabulary} as int)"


def _weights(source, vocabulary=VOCABULARY):
    """Views with the weights trained on a view of (label, combined_text)."""
    return {
        "counts": f"""
select {_word_id(vocabulary)} as feature, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg
from (select word, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
      from (select label, unnest({_WORDS}) as word from {source}) group by word) group by 1""",
        "weights": f"""
select feature, n_pos, n_neg,
       cast(round((ln((n_pos + 1) / (sum(n_pos) over () + {vocabulary}))
                 - ln((n_neg + 1) / (sum(n_neg) over () + {vocabulary}))) * 1000000) as bigint)
         as weight_micro,
       cast(round((select ln((count(*) filter (where label = 1) + 1)
                           / (count(*) filter (where label = 0) + 1)) from {source}) * 1000000)
            as bigint) as bias_micro,
       cast(round(ln((sum(n_neg) over () + {vocabulary}) / (sum(n_pos) over () + {vocabulary})) * 1000000)
            as bigint) as unseen_micro
from counts""",
        "model": "select max(bias_micro) as bias, max(unseen_micro) as unseen from weights",
    }


def _post_ids(source, vocabulary=VOCABULARY):
    """SQL for (submission_id, feature, n) of a view of (submission_id, combined_text)."""
    return f"""
select submission_id, feature, cast(sum(n) as bigint) as n
from (select submission_id, word, count(*) as n
      from (select submission_id, unnest({_WORDS}) as word from {source}) group by all)
join (select word, {_word_id(vocabulary)} as feature
      from (select distinct unnest({_WORDS}) as word from {source})) using (word)
group by all"""


def _logits(source):
    """SQL for (submission_id, logits) of a view of (submission_id, combined_text)."""
    return f"""
select p.submission_id, cast(any_value(m.bias) + coalesce(any_value(t.micro), 0) as bigint) / 1000000.0::double
         as logits
from {source} p cross join model m
left join (select submission_id, sum(n * coalesce(weight_micro, m.unseen)) as micro
           from ({_post_ids(source)}) cross join model m left join weights using (feature) group by 1) t
  on t.submission_id = p.submission_id
group by p.submission_id"""


LOGISTIC_SETTINGS = {
    "none": (0.0, 0.0),
    "ridge_low": (0.01, 0.0),
    "ridge_mid": (0.1, 0.0),
    "ridge_high": (0.5, 0.0),
    "mixed_low": (0.01, 0.5),
    "mixed_mid": (0.1, 0.5),
    "mixed_high": (0.5, 0.5),
    "lasso_low": (0.01, 1.0),
    "lasso_mid": (0.1, 1.0),
}


def _logistic(settings, epochs=5, rate=2.0):
    """Views from `split` to the weights of each setting after some epochs."""
    rows = ", ".join(
        f"('{name}', {reg}::double, {mix}::double)" for name, (reg, mix) in settings.items()
    )
    views = {
        "settings": f"select * from (values {rows}) t(setting, reg, mixing)",
        "id_counts": _post_ids("split", 65536),
        "features": """
select submission_id, feature,
       cast(round(n * 1000 / sqrt(cast(sum(n * n) over (partition by submission_id) as double))) as bigint) as v
from id_counts union all select submission_id, 65536, 1000 from split""",
        "train_features": """
select f.*, label from features f join split using (submission_id) where split = 'train'""",
        "w0": "select setting, cast(null as int) as feature, 0::bigint as w from settings",
    }
    for k in range(1, epochs + 1):
        views[f"r{k}"] = f"""
select submission_id, setting,
       cast(round((any_value(label) - 1 / (1 + exp(-(coalesce(sum(v * w), 0)::bigint / 1000000000.0::double)))) * 1000000)
            as bigint) as r
from train_features cross join settings left join w{k - 1} using (setting, feature) group by all"""
        views[f"w{k}"] = f"""
select setting, feature, cast(round(sign(after) * greatest(abs(after) - cut, 0.0::double)) as bigint) as w
from (select setting, feature,
             coalesce(w, 0)::double * case when feature = 65536 then 1.0::double
                                           else 1 - {rate}::double * reg * (1 - mixing) end
               + g / (total * 1000.0::double) * {rate}::double as after,
             case when feature = 65536 then 0.0::double else {rate}::double * reg * mixing * 1000000 end as cut
      from (select setting, feature, sum(v * r)::bigint as g from train_features join r{k} using (submission_id)
            group by all)
      join settings using (setting) left join w{k - 1} using (setting, feature),
           (select greatest(count(*), 1)::double as total from split where split = 'train'))"""
    views["held_margins"] = f"""
select submission_id, setting, label, split, cast(sum(v * coalesce(w, 0)) as bigint) / 1000000000.0::double as logits
from (select f.*, label, split from features f join split using (submission_id) where split <> 'train')
cross join settings left join w{epochs} using (setting, feature) group by all"""
    return views


N_MERGES = 16


def _merges(n):
    """Views from `texts` to the words with their symbols after each of n merges."""
    views = {
        "merged0": f"""
select word, count(*) as n, regexp_replace(word, '(.)', '<\\1>', 'gs') as symbols
from (select unnest({_WORDS}) as word from texts) group by word""",
    }
    for k in range(1, n + 1):
        views[f"best{k}"] = f"""
select s[i] as "left", s[i + 1] as "right", cast(sum(n) as bigint) as n
from (select n, string_split(symbols[2:-2], '><') as s from merged{k - 1}), unnest(range(1, len(s))) t(i)
group by 1, 2 having sum(n) >= 2 order by sum(n) desc, 1, 2 limit 1"""
        views[f"merged{k}"] = f"""
select word, w.n, coalesce(replace(symbols, '<' || "left" || '><' || "right" || '>',
                                   '<' || "left" || "right" || '>'), symbols) as symbols
from merged{k - 1} w left join best{k} on true"""
    return views


VIEWS = {
    "posts": """
select cast(d.doc_id as varchar) as submission_id,
       split_part(d.text, chr(10), 1) as title,
       substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) as selftext,
       case when l.doc_id is null then null
            when d.doc_id % 23 = 0 then 'META'
            when quality = 1 and toxic = 0
                 then case when d.doc_id % 2 = 0 then 'Asshole' else 'Not the A-hole' end
            when quality = 1 then 'Everyone Sucks'
            when toxic = 0 then 'Not enough info'
            else 'No A-holes here' end as link_flair_text,
       cast(1704067200 + d.doc_id * 3600 as double) as created_utc,
       'https://example.org/post/' || cast(d.doc_id as varchar) as url,
       d.lang
from documents d left join labels l on d.doc_id = l.doc_id""",
    "scored": """
select event_id as submission_id, cast(ts as date) as post_date,
       value / 50 - 1 as logits,
       case when value / 50 - 1 > 0.5 then 1 else 0 end as pred,
       cast(case event_type when 'click' then 1 when 'view' then 0
                            when 'purchase' then 2 when 'signup' then 3
                            else case when user_id % 2 = 0 then 4 end end as double) as outcome
from events""",
    "graded": f"select *, {_ACCURATE} as accurate from scored",
    "extremes": """
select scored.* from scored, (
  select quantile_cont(logits, 0.1) filter (where pred = 0) as t0,
         quantile_cont(logits, 0.9) filter (where pred = 1) as t1 from scored) limits
where logits < t0 or logits > t1""",
    "decided": f"select *, {_POST_DATE} as post_date from posts where {_DECIDED}",
    "training": f"""
select submission_id, title, selftext, cast({_outcome('link_flair_text')} as int) as label,
       {_COMBINED} as combined_text
from posts where {_TWO}""",
    "texts": f"select submission_id, {_COMBINED} as combined_text from posts",
    **_weights("training"),
    "logits": _logits("texts"),
    "predictions": f"""
select submission_id, title, {_POST_DATE} as post_date, url, date '{RUN_DATE}' as date_created,
       logits, case when logits > 0.5 then 1 else 0 end as pred, link_flair_text, lang
from posts join logits using (submission_id)""",
    "pending": f"""
select title, post_date, url, date_created, logits, pred, {_message_id(RUN_DATE)} as message_id
from predictions""",
    "lookup": f"""
select title, link_flair_text as outcome_str, {_outcome('link_flair_text')} as outcome
from (select title, link_flair_text, row_number() over (
        partition by title order by created_utc desc, submission_id) as place from posts)
where place = 1""",
    "merged": "select p.*, outcome_str, outcome from pending p left join lookup l on p.title = l.title",
    "split": """
select *, case when place <= floor(hold / 2) then 'val' when place <= hold then 'test'
               else 'train' end as split
from (select *, row_number() over (partition by label order by md5(submission_id || ':42')) as place,
             ceil(count(*) over (partition by label) * 0.132865::double) as hold
      from training)""",
    "days": f"""
select post_date as date, outcome_type, cast(sum(case when member then accurate end) as bigint) as success,
       count(*) filter (where member) as n
from graded cross join (values ('Total'), ('YTA'), ('NTA')) types(outcome_type)
cross join lateral (select outcome_type = 'Total' or (outcome_type = 'YTA' and outcome = 1)
                        or (outcome_type = 'NTA' and outcome = 0) as member) flags
group by 1, 2""",
    "history": f"""
select {_HISTORY} from (
  select date, outcome_type, coalesce(success, 0) as success, n, {_RATES.replace('success', 'coalesce(success, 0)')},
         date as min_post_date, date as max_post_date from days)""",
}

# Views trained on the train part only.
_SPLIT_VIEWS = {
    "train_part": "select label, combined_text from split where split = 'train'",
    "held_out": "select submission_id, label, split, combined_text from split where split <> 'train'",
    **_weights("train_part"),
    "held_logits": _logits("held_out"),
    "evaluated": """
select submission_id, label, split, logits, case when logits > 0.5 then 1 else 0 end as pred
from held_out join held_logits using (submission_id)""",
}


def _sql(final, *views, own=None):
    """A statement with the named views in front, `own` ones first where names meet."""
    chosen = {name: VIEWS[name] for name in views}
    chosen.update(own or {})
    chained = r"(w|r|best|merged)\d+|features|train_features|weights|counts"
    head = ",\n".join(
        f"{name} as {'materialized ' if re.fullmatch(chained, name) else ''}({text})"
        for name, text in chosen.items()
    )
    return f"with {head}\n{final}" if head else final


_MODEL = ("posts", "training", "counts", "weights", "model", "texts", "logits")
_PENDING = (*_MODEL, "predictions", "pending")
_MERGED = (*_PENDING, "lookup", "merged")
_LOG_VIEW = "submission_id, title, link_flair_text as outcome_str, post_date"
_RESOLVED = (
    "title, post_date, url, date_created, logits, pred, message_id, outcome_str, outcome"
)
_WAITING = "title, post_date, url, date_created, logits, pred, message_id"
_SPLIT = ("posts", "training", "split")


def _summary(source, unsampled, date):
    return f"""
select date '{date}' as date, outcome_type, coalesce(success, 0) as success, n,
       {_RATES.replace('success', 'coalesce(success, 0)')},
       (select min(post_date) from {unsampled}) as min_post_date,
       (select max(post_date) from {unsampled}) as max_post_date
from (select outcome_type, cast(sum(case when member then accurate end) as bigint) as success,
             count(*) filter (where member) as n
      from {source} cross join (values ('Total'), ('YTA'), ('NTA')) types(outcome_type)
      cross join lateral (select outcome_type = 'Total' or (outcome_type = 'YTA' and outcome = 1)
                              or (outcome_type = 'NTA' and outcome = 0) as member) flags
      group by 1)"""


_PREDICT_VIEWS = {
    "state": f"""
select title, post_date, url, date '2024-02-28' as date_created, logits, pred,
       {_message_id('2024-02-28')} as message_id from predictions where lang = 'en'""",
    "fresh": """
select * from predictions p where link_flair_text is null
  and not exists (select 1 from state s where s.title is not distinct from p.title)""",
    "chosen": f"""
select fresh.* from fresh, (
  select quantile_cont(logits, 0.1) filter (where pred = 0) as t0,
         quantile_cont(logits, 0.9) filter (where pred = 1) as t1 from fresh) limits
where logits < t0 or logits > t1
order by md5(submission_id || ':{SEED}'), submission_id limit 2""",
}

_REPORT_VIEWS = {
    "batch": f"""
select submission_id, post_date, {_outcome('link_flair_text')} as outcome
from decided where {_TWO}""",
    "balanced": f"""
select * from (select *, row_number() over (
    partition by outcome order by md5(submission_id || ':{SEED}')) as place from batch)
where place <= (select count(*) from batch where outcome = 1)""",
    "report": f"""
select submission_id, post_date, outcome, {_ACCURATE} as accurate
from (select b.*, case when logits > 0.5 then 1 else 0 end as pred
      from balanced b join logits using (submission_id))""",
    "summary": _summary("report", "batch", RUN_DATE),
    "updated": f"select {_HISTORY} from history union all select {_HISTORY} from summary",
}


ORACLES = {
    "newest_posts": _sql(
        "select submission_id, title, link_flair_text, created_utc, url from posts "
        "order by created_utc desc, submission_id limit 500",
        "posts",
    ),
    "training_posts": _sql(
        "select submission_id, title, selftext, label from training", "posts", "training"
    ),
    "log_for_batch_dates": _sql(
        f"select {_LOG_VIEW} from decided where post_date in (select {_POST_DATE} from ("
        "select * from posts order by created_utc desc, submission_id limit 500) "
        f"where {_DECIDED})",
        "posts",
        "decided",
    ),
    "log_last_n_days": _sql(
        f"select {_LOG_VIEW} from decided "
        "where post_date between date '2024-01-19' and date '2024-02-01'",
        "posts",
        "decided",
    ),
    "append_daily_log": _sql(f"select {_LOG_VIEW} from decided", "posts", "decided"),
    "write_state": _sql("select * from pending where pred = 1", *_PENDING),
    "archive_resolved": _sql(
        f"select {_RESOLVED}, '2024-03-02-06-00' as run_ts from merged where outcome is not null",
        *_MERGED,
    ),
    "undecided_posts": _sql(
        "select submission_id, title, url from posts where link_flair_text is null", "posts"
    ),
    "decided_posts": _sql(
        f"select submission_id, link_flair_text from posts where {_DECIDED}", "posts"
    ),
    "binary_verdict_posts": _sql(
        f"select submission_id, link_flair_text from posts where {_TWO}", "posts"
    ),
    "length_filtered_posts": _sql(
        "select submission_id, cast(length(selftext) as int) as n_chars from posts "
        "where length(selftext) > 200 and length(selftext) < 6500",
        "posts",
    ),
    "post_dates": _sql(f"select submission_id, {_POST_DATE} as post_date from posts", "posts"),
    "combined_text": _sql("select * from texts", "posts", "texts"),
    "coded_outcomes": _sql(
        f"select submission_id, link_flair_text, {_outcome('link_flair_text')} as outcome from posts",
        "posts",
    ),
    "binary_labels": _sql(
        "select submission_id, case when link_flair_text = 'YTA' then 1 else 0 end as label, "
        "case when link_flair_text = 'Asshole' then 1 else 0 end as long_name_label from posts",
        "posts",
    ),
    "thresholded": _sql("select submission_id, logits, pred from scored", "scored"),
    "truncated_titles": _sql(
        f"select submission_id, {_short('title')} as short_title from posts", "posts"
    ),
    "accuracy_flags": _sql(
        "select submission_id, pred, outcome, accurate from graded", "scored", "graded"
    ),
    "ruling_messages": _sql(
        f"select submission_id, pred, {_message_id(RUN_DATE)} as message_id, {_ruling()} as message "
        "from predictions where link_flair_text is null",
        *_MODEL,
        "predictions",
    ),
    "update_messages": _sql(
        f"select message_id, {_GRADE} as grade, {_update()} as message from merged "
        "where outcome is not null",
        *_MERGED,
    ),
    "grade_counts": _sql(
        f"select {_GRADE} as grade, count(*) as n from scored where outcome is not null group by 1",
        "scored",
    ),
    "unseen_posts_by_title": _sql(
        "select submission_id, title, url from posts p where link_flair_text is null "
        "and not exists (select 1 from posts s where s.lang = 'en' "
        "and s.title is not distinct from p.title)",
        "posts",
    ),
    "new_posts_by_id": _sql(
        "select submission_id, title, link_flair_text, post_date from decided "
        "where submission_id not in (select submission_id from decided where lang = 'en')",
        "posts",
        "decided",
    ),
    "new_posts_by_index": _sql(
        "select submission_id, title, link_flair_text, post_date from decided "
        "where submission_id not in (select submission_id from decided where lang = 'en')",
        "posts",
        "decided",
    ),
    "title_lookup": _sql(
        "select title, outcome_str from lookup "
        "where title in (select title from posts where lang = 'en')",
        "posts",
        "lookup",
    ),
    "resolve_predictions": _sql(f"select {_RESOLVED} from merged", *_MERGED),
    "resolved_predictions": _sql(
        f"select {_RESOLVED} from merged where outcome is not null", *_MERGED
    ),
    "still_unresolved": _sql(f"select {_WAITING} from merged where outcome is null", *_MERGED),
    "verdict_counts": _sql(
        f"select count(*) as n_scanned, "
        f"count(*) filter (where upper(link_flair_text) in ({_spellings(1.0)})) as n_yta, "
        f"count(*) filter (where upper(link_flair_text) in ({_spellings(0.0)})) as n_nta from posts",
        "posts",
    ),
    "outcome_distribution": _sql(
        "select outcome, n, cast(round(n * 100.0::double / sum(n) over (), 1) as varchar) || '%' as share "
        "from (select outcome, count(*) as n from scored where outcome is not null group by 1)",
        "scored",
    ),
    "post_date_range": _sql(
        "select min(post_date) as min_post_date, max(post_date) as max_post_date from scored",
        "scored",
    ),
    "confusion_matrix": _sql(
        "select outcome, count(*) filter (where pred = 0) as predicted_0, "
        "count(*) filter (where pred = 1) as predicted_1 from scored "
        "where outcome is not null group by 1",
        "scored",
    ),
    "binomial_stats": _sql(
        f"select success, n, {_RATES} from (select cast(sum(accurate) as bigint) as success, "
        "count(*) as n from graded)",
        "scored",
        "graded",
    ),
    "accuracy_summary": _sql(
        f"select {_HISTORY} from summary",
        "scored",
        "graded",
        own={
            "two": "select * from graded where outcome in (0, 1)",
            "summary": _summary("two", "graded", RUN_DATE),
        },
    ),
    "confidence_thresholds": _sql(
        "select quantile_cont(logits, 0.1) filter (where pred = 0) as t0, "
        "quantile_cont(logits, 0.9) filter (where pred = 1) as t1 from scored",
        "scored",
    ),
    "control_limits": _sql(
        "select round(avg(rate), 10) as mean_rate, round(stddev_samp(rate), 10) as sd_rate, "
        "round(avg(rate) + 3 * stddev_samp(rate), 10) as ucl, "
        "round(avg(rate) - 3 * stddev_samp(rate), 10) as lcl "
        "from history where outcome_type = 'Total'",
        "scored",
        "graded",
        "days",
        "history",
    ),
    "eval_accuracy": _sql(
        "select split, count(*) as n, avg(cast(pred = label as int)) as accuracy "
        "from evaluated group by 1",
        *_SPLIT,
        own=_SPLIT_VIEWS,
    ),
    "selective_accuracy": _sql(
        f"select success, n, {_RATES} from (select cast(sum(accurate) as bigint) as success, "
        "count(*) as n from two, (select quantile_cont(logits, 0.1) filter (where pred = 0) as t0, "
        "quantile_cont(logits, 0.9) filter (where pred = 1) as t1 from two) limits "
        "where logits < t0 or logits > t1)",
        "scored",
        "graded",
        own={"two": "select * from graded where outcome in (0, 1)"},
    ),
    "token_length_stats": _sql(
        f"select max(n) as max_tokens, min(n) as min_tokens "
        f"from (select cast(len({_WORDS}) as int) as n from texts)",
        "posts",
        "texts",
    ),
    "split_sizes": _sql("select split, count(*) as n from split group by 1", *_SPLIT),
    "confident_extremes": _sql("select * from extremes", "scored", "extremes"),
    "ranked_extremes": _sql(
        "select * from extremes order by logits, submission_id", "scored", "extremes"
    ),
    "sample_n": _sql(
        f"select * from extremes order by md5(cast(submission_id as varchar) || ':{SEED}'), "
        "submission_id limit 20",
        "scored",
        "extremes",
    ),
    "balanced_sample": _sql(
        "select submission_id, post_date, logits, pred, outcome from (select *, row_number() over ("
        f"partition by outcome order by md5(cast(submission_id as varchar) || ':{SEED}')) as place "
        "from scored where outcome is not null) "
        "where place <= (select count(*) from scored where outcome = 1)",
        "scored",
    ),
    "stratified_split": _sql("select submission_id, label, split from split", *_SPLIT),
    "stratified_subsample": _sql(
        "select submission_id, label from (select *, row_number() over ("
        "partition by label order by md5(submission_id || ':42')) as place, "
        "count(*) over (partition by label) as total from training) "
        "where place > ceil(total * 0.5)",
        "posts",
        "training",
    ),
    "union_distinct": _sql(
        "select post_date, pred, outcome from scored union "
        "select post_date, pred, outcome from scored where outcome is not null",
        "scored",
    ),
    "union_all_log": _sql(
        "select submission_id, link_flair_text, post_date from decided where lang = 'en' union all "
        "select submission_id, link_flair_text, post_date from decided",
        "posts",
        "decided",
    ),
    "history_upsert": _sql(
        f"select {_HISTORY} from history where date <> date '2024-01-15' "
        f"union all select {_HISTORY} from summary",
        "scored",
        "graded",
        "days",
        "history",
        own={"summary": _summary("graded", "graded", "2024-01-15")},
    ),
    "token_counts": _sql(
        f"select submission_id, cast(len({_WORDS}) as int) as n_tokens, "
        f"cast(least(len({_WORDS}), 4096) as int) as n_used from texts",
        "posts",
        "texts",
    ),
    "train_weights": _sql(
        "select * from weights", "posts", "training", "counts", "weights"
    ),
    "score_posts": _sql("select * from logits", *_MODEL),
    "score_with_udf": _sql("select * from logits", *_MODEL),
    "score_by_join": _sql("select * from logits", *_MODEL),
    "score_stored_model": _sql("select * from logits", *_MODEL),
    "subword_merges": _sql(
        " union all ".join(
            f'select {k} as step, "left", "right", n from best{k}' for k in range(1, N_MERGES + 1)
        ),
        "posts",
        "texts",
        own=_merges(N_MERGES),
    ),
    "subword_counts": _sql(
        "select submission_id, coalesce(n, 0) as n_tokens, least(coalesce(n, 0), 4096) as n_used from texts "
        "left join (select submission_id, cast(sum(size) as bigint) as n "
        f"from (select submission_id, unnest({_WORDS}) as word from texts) "
        f"join (select word, len(regexp_extract_all(symbols, '<')) as size from merged{N_MERGES}) using (word) "
        "group by 1) using (submission_id)",
        "posts",
        "texts",
        own=_merges(N_MERGES),
    ),
    "coverage_curve": _sql(
        "select confidence, n_covered, n_covered / total as coverage, success, success / n_covered as accuracy "
        "from (select confidence, cast(sum(n) over by_level as bigint) as n_covered, "
        "cast(sum(hits) over by_level as bigint) as success, sum(n) over () as total "
        "from (select abs(logits - 0.5::double) as confidence, count(*) as n, sum(accurate) as hits "
        "from graded where outcome in (0, 1) group by 1) "
        "window by_level as (order by confidence desc))",
        "scored",
        "graded",
    ),
    "stream_score_stored": _sql(
        "select submission_id, logits, case when logits > 0.5 then 1 else 0 end as pred from logits",
        *_MODEL,
    ),
    "predict_cycle_python": _sql(
        f"select {_WAITING} from state union select title, post_date, url, date_created, logits, "
        f"pred, {_message_id(RUN_DATE)} as message_id from chosen",
        *_MODEL,
        "predictions",
        own=_PREDICT_VIEWS,
    ),
    "outbox_messages": _sql(
        f"select message_id, 'ruling' as kind, min(message) as message, min(date_created) as day from ("
        f"select date_created, {_message_id(RUN_DATE)} as message_id, {_ruling()} as message from twenty) "
        "group by message_id",
        *_MODEL,
        "predictions",
        own={
            "twenty": f"""
select undecided.* from (select * from predictions where link_flair_text is null) undecided, (
  select quantile_cont(logits, 0.1) filter (where pred = 0) as t0,
         quantile_cont(logits, 0.9) filter (where pred = 1) as t1
  from predictions where link_flair_text is null) limits
where logits < t0 or logits > t1
order by md5(submission_id || ':{SEED}'), submission_id limit 20""",
        },
    ),
    "assess_state": _sql(f"select {_WAITING} from merged where outcome is null", *_MERGED),
    "outbox_updates": _sql(
        "select message_id, 'update' as kind, min(message) as message, min(date_created) as day "
        f"from (select message_id, date_created, {_update()} as message from merged "
        "where outcome is not null) group by message_id",
        *_MERGED,
    ),
    "state_or_empty": _sql("select * from pending", *_PENDING),
    "history_snapshot": _sql(
        f"select {_HISTORY}, '{RUN_DATE}' as run_date from updated",
        *_MODEL,
        "decided",
        "scored",
        "graded",
        "days",
        "history",
        own=_REPORT_VIEWS,
    ),
    "history_keep_day": _sql(
        "select * from history", "scored", "graded", "days", "history"
    ),
    "report_confusion": _sql(
        "select outcome, count(*) filter (where pred = 0) as predicted_0, "
        "count(*) filter (where pred = 1) as predicted_1 from (select b.outcome, "
        "case when logits > 0.5 then 1 else 0 end as pred from balanced b join logits using (submission_id)) "
        "group by 1",
        *_MODEL,
        "decided",
        own={name: _REPORT_VIEWS[name] for name in ("batch", "balanced")},
    ),
    "report_distribution": _sql(
        "select outcome, n, cast(round(n * 100.0::double / sum(n) over (), 1) as varchar) || '%' as share "
        "from (select outcome, count(*) as n from batch group by 1)",
        "posts",
        "decided",
        own={"batch": _REPORT_VIEWS["batch"]},
    ),
    "report_dates": _sql(
        "select min(post_date) as min_post_date, max(post_date) as max_post_date from batch",
        "posts",
        "decided",
        own={"batch": _REPORT_VIEWS["batch"]},
    ),
    "train_ml_pipeline": _sql(
        "select submission_id, label, split, round(logits, 6) as logits, "
        "case when logits > 0.5 then 1 else 0 end as pred from held_out join bayes using (submission_id)",
        *_SPLIT,
        own={
            **_SPLIT_VIEWS,
            "totals": "select sum(n_pos) as pos, sum(n_neg) as neg from counts",
            "priors": """
select count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from train_part""",
            **_weights("train_part", 65536),
            "ids": _post_ids("held_out", 65536),
            "bayes": """
select h.submission_id, any_value(ln(p.pos + 1) - ln(p.neg + 1))
       + coalesce(sum(case when i.feature is not null then n * (
           ln(coalesce(n_pos, 0) + 1) - ln(t.pos + 65536) - ln(coalesce(n_neg, 0) + 1) + ln(t.neg + 65536)) end), 0)
         as logits
from held_out h cross join totals t cross join priors p left join ids i using (submission_id)
left join counts using (feature) group by h.submission_id""",
        },
    ),
    "train_logistic": _sql(
        "select feature, w as weight_micro from w5", *_SPLIT, own=_logistic({"none": (0.0, 0.0)})
    ),
    "logistic_scores": _sql(
        "select submission_id, label, split, logits, case when logits > 0.5 then 1 else 0 end as pred "
        "from held_margins",
        *_SPLIT,
        own=_logistic({"none": (0.0, 0.0)}),
    ),
    "tune_ml_pipeline": _sql(
        "select setting, reg, mixing, n, \"right\", accuracy, "
        "row_number() over (order by accuracy desc nulls last, setting) = 1 as best "
        "from (select setting, count(submission_id) as n, "
        "count(*) filter (where (logits > 0) = (label = 1)) as \"right\", "
        "count(*) filter (where (logits > 0) = (label = 1)) / nullif(count(submission_id), 0) as accuracy "
        "from settings left join (select * from held_margins where split = 'val') using (setting) group by 1) "
        "join settings using (setting)",
        *_SPLIT,
        own=_logistic(LOGISTIC_SETTINGS),
    ),
    "stream_dedup_ingest": _sql(f"select {_LOG_VIEW} from decided", "posts", "decided"),
    "stream_daily_accuracy": _sql(
        "select * from history", "scored", "graded", "days", "history"
    ),
    "stream_resolve": _sql(
        f"select {_RESOLVED} from merged where outcome is not null", *_MERGED
    ),
    "stream_score": _sql(
        "select submission_id, logits, case when logits > 0.5 then 1 else 0 end as pred from logits",
        *_MODEL,
    ),
    "predict_cycle": _sql(
        f"select {_WAITING} from state union select title, post_date, url, date_created, logits, "
        f"pred, {_message_id(RUN_DATE)} as message_id from chosen",
        *_MODEL,
        "predictions",
        own=_PREDICT_VIEWS,
    ),
    "assess_cycle": _sql(
        f"select {_RESOLVED}, {_GRADE} as grade, {_update()} as message from merged "
        "where outcome is not null",
        *_MERGED,
    ),
    "monitor_cycle": _sql(
        f"select *, {_ACCURATE} as accurate from (select submission_id, title, selftext, "
        f"link_flair_text as outcome_str, {_COMBINED} as combined_text, "
        f"{_outcome('link_flair_text')} as outcome, logits, "
        "case when logits > 0.5 then 1 else 0 end as pred, post_date "
        "from decided join logits using (submission_id) "
        "where submission_id not in (select submission_id from decided where lang = 'en'))",
        *_MODEL,
        "decided",
    ),
    "monitor_report": _sql(
        f"select {_HISTORY}, round(mean, 10) as mean_rate, round(mean + 3 * sd, 10) as ucl, "
        "round(mean - 3 * sd, 10) as lcl from updated, (select avg(rate) as mean, "
        "stddev_samp(rate) as sd from updated where outcome_type = 'Total') limits",
        *_MODEL,
        "decided",
        "scored",
        "graded",
        "days",
        "history",
        own=_REPORT_VIEWS,
    ),
    "train_eval": _sql(
        'select split, label, count(*) as n, count(*) filter (where pred = label) as "right" '
        "from evaluated group by 1, 2",
        *_SPLIT,
        own=_SPLIT_VIEWS,
    ),
}
