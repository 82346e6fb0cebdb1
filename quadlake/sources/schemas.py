"""Declared schemas: the supplied tables, and the tables the question functions read."""

from __future__ import annotations

from quadlake.functions import fixed

_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def ddl(table: str) -> str:
    return _DDL[table]


def _flags(*names: str) -> str:
    return ", ".join(f"{n} boolean" for n in names)


_CATEGORIES = _flags(*["ge_" + c[3:].lower() for c in fixed.CATEGORY_CODES])
_DAYS = _flags(*["meets_" + d.lower() for d in fixed.DAY_TOKENS])
_RESTRICTIONS = _flags(*["r_" + c.lower() for c in fixed.RESTRICTION_CODES])
_HOURS = ", ".join(f"open_{d.lower()} string, close_{d.lower()} string" for d in fixed.HOURS_DAYS)

QUESTIONS = {
    # Offerings
    "department": "year string, quarter string, department string, department_name string",
    "course": "course_key bigint, year string, quarter string, department string, course_number string, "
              f"course_numeric int, course_id string, title string, {_CATEGORIES}",
    "section": "section_key bigint, course_key bigint, section_code int, section_type string, units string, "
               "status string, enrolled int, total_enrolled int, capacity int, waitlist int, waitlist_cap int, "
               f"requested int, reserved int, cancelled boolean, web_url string, {_RESTRICTIONS}",
    "meeting": "meeting_key bigint, section_key bigint, meeting_index int, start_minute int, end_minute int, "
               f"{_DAYS}",
    "place": "meeting_key bigint, building string, room string",
    "staff": "section_key bigint, instructor string",
    "grade": "section_key bigint, a int, b int, c int, d int, f int, p int, np int, w int, average double",
    "snapshot": "section_key bigint, day date, total_enrolled int, capacity int, waitlist int, waitlist_cap int, "
                "requested int, reserved int, status string",
    "material": "section_key bigint, material_key bigint, author string, title string, edition string, format string, "
                "isbn string, required string",
    "tutoring": f"course_key bigint, instructor string, building string, start_minute int, end_minute int, {_DAYS}",
    # Catalogue
    "course_view": "course_id string, department string, course_number string, course_numeric int, title string, "
                   f"description string, min_units decimal(4,2), max_units decimal(4,2), {_CATEGORIES}",
    "person_view": "person_id string, name string, title string, department string, email string",
    "degree": "id string, name string, division string",
    "major": "id string, degree_id string, code string, name string",
    "major_year": "major_id string, catalog_year string, specialization_required boolean",
    "major_requirement_link": "major_id string, specialization_id string, catalog_year string, requirement_id bigint",
    "requirement": "id bigint, requirements string",
    "minor": "id string, name string",
    "minor_requirement": "minor_id string, catalog_year string, requirements string",
    "specialization": "id string, major_id string, name string",
    "specialization_requirement": "specialization_id string, catalog_year string, requirements string",
    "school_requirement": "catalog_year string, kind string, requirements string",
    "sample_program": "program_id string, name string",
    "variation": "program_id string, variation_id bigint, label string, "
                 "years array<struct<year: string, fall: array<string>, winter: array<string>, spring: array<string>>>",
    "exam": "exam string, catalogue_name string",
    "reward": "reward_id string, units int, elective_units int, courses string, "
              + _CATEGORIES.replace("boolean", "int"),
    "score": "exam string, score int, reward_id string",
    # Campus
    "event": "restaurant string, title string, image string, description string, starts timestamp_ntz, "
             "ends timestamp_ntz, updated_at timestamp_ntz",
    "station": "restaurant string, station_id string, name string",
    "dish": "sku string, station_id string, name string, description string, ingredients string, category string, "
            "image_url string",
    "served": "restaurant string, date date, period_id int, station_id string, sku string",
    "schedule": "schedule_id bigint, restaurant string, name string, kind string, starts date, ends date",
    "period": f"schedule_id bigint, period_id int, position int, {_HOURS}",
    "room": "room string, name string, location string, capacity int, description string, directions string, "
            "tech_enhanced boolean, url string",
    "slot": "room string, starts timestamp_ntz, ends timestamp_ntz, available boolean",
    "occupancy": "location_id string, place string, location string, count int, percentage float, timestamp timestamp",
    "term": "year string, quarter string, instruction_start date, instruction_end date, finals_start date, "
            "finals_end date, soc_available date",
}
