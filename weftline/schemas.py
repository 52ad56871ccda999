"""Shapes of records, and the registries of fields that scoring and verification run over."""

from __future__ import annotations

from typing import NamedTuple

# The shapes of records, entries, gold sets and checks, as they are read and written.
CONFERENCE = "struct<full_name:string,acronym:string,url:string,edition_number:int>"
DATES = "struct<start_date:string,end_date:string>"
VENUE = "struct<city:string,country:string>"
DEADLINES = "struct<submission:string,notification:string,camera_ready:string>"
SPEAKERS = "array<struct<name:string,affiliation:string,country:string>>"
COMMITTEE = "array<struct<name:string,affiliation:string,country:string,role:string>>"
PUBLICATION = "struct<publisher:string,series:string>"
#: A merged record.
RECORD = (
    f"struct<conference:{CONFERENCE},dates:{DATES},venue:{VENUE},deadlines:{DEADLINES},topics:array<string>,"
    f"keynote_speakers:{SPEAKERS},program_committee:{COMMITTEE},publication:{PUBLICATION}>"
)
#: What the first pass is asked for; the other two give keynote_speakers and program_committee.
BASIC = (
    "struct<full_name:string,acronym:string,edition_number:int,start_date:string,end_date:string,city:string,country:string,"
    "submission_deadline:string,notification_date:string,camera_ready_date:string,topics:array<string>,publisher:string,series:string>"
)
ENTRY = (
    "model string, vllm_extra_args array<string>, backend string, url string, status string, error string, elapsed_sec double, "
    "pages_fetched int, attempts int, fields_filled int, fields_total int, fill_pct double, high_confidence_count int, "
    f"low_confidence_fields array<string>, warnings array<string>, data {RECORD}, confidence map<string,string>"
)
GOLD = f"url string, ground_truth {RECORD}, aliases map<string,array<string>>, notes string"
URL_CHECK = "final_url string, status_code int, redirected boolean, error string"

#: Sections whose members are counted, in order.
SECTIONS = {
    "conference": ["full_name", "acronym", "url", "edition_number"],
    "dates": ["start_date", "end_date"],
    "venue": ["city", "country"],
    "deadlines": ["submission", "notification", "camera_ready"],
    "publication": ["publisher", "series"],
}
LISTS = ["topics", "keynote_speakers", "program_committee"]


class Field(NamedTuple):
    path: str
    category: str
    matcher: str


# The fields that are scored, their categories and the matcher of each.
SCALAR_FIELDS = [
    Field("conference.full_name", "identity", "string"),
    Field("conference.acronym", "identity", "acronym"),
    Field("conference.edition_number", "identity", "edition"),
    Field("dates.start_date", "dates", "date"),
    Field("dates.end_date", "dates", "date"),
    Field("venue.city", "location", "string"),
    Field("venue.country", "location", "country"),
    Field("deadlines.submission", "dates", "date"),
    Field("deadlines.notification", "dates", "date"),
    Field("deadlines.camera_ready", "dates", "date"),
    Field("publication.publisher", "publication", "string"),
    Field("publication.series", "publication", "string"),
]
LIST_FIELDS = [
    Field("topics", "topics", "topic"),
    Field("keynote_speakers", "speakers", "speaker"),
    Field("program_committee", "committee", "speaker"),
]
CATEGORIES = ["dates", "location", "identity", "publication", "topics", "speakers", "committee"]

# The fields that are looked for in the source, in this order; dates in any written form.
VERIFIED = [
    "conference.full_name", "conference.acronym", "dates.start_date", "dates.end_date", "venue.city", "venue.country",
    "deadlines.submission", "deadlines.notification", "deadlines.camera_ready", "publication.publisher",
]
VERIFIED_DATES = {"dates.start_date", "dates.end_date", "deadlines.submission", "deadlines.notification", "deadlines.camera_ready"}
