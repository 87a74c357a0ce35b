"""Row types of the datasets."""

from __future__ import annotations

SECTIONS = "collection string, author string, year int, year_raw string, ganzhi string, text string, source_url string"
ANTHOLOGY = "source string, volume int, marker string, year_approx int, n_chars int, text string, offset int"
COHORT = "author string, title string, cohort string, historian_label string, n_chars int, text string, source_url string"
GAZETTEER = "source string, page string, n_chars int, text string"
WORKS = "source string, cohort string, label string, urn string, n_chars int, text string"
METADATA = (
    "poet string, birth int, death int, origin string, cohort string, historian_label string,"
    " wikisource_collection string, note string"
)
LEXICON = (
    "lexicon string, version string, description string, categories map<string,string>, entries"
    " array<struct<id:string,forms:array<string>,category:string,specificity:double,gloss_en:string,locus:string,note:string>>"
)
FORMS = "ord int, form string, form_len int, entry_id string, category string, specificity double"
YEARLY = (
    "author string, year int, n_chars int, loyalist_density100 double, control_density100 double, loyalist_entries string"
)
