"""Short names and people of several directory entries."""

from quadlake.plans import people


def test_every_entry_of_a_person_counts(spark):
    directory = spark.createDataFrame(
        [("p", "Max Featherstonehaughs", "Staff", False), ("p", "Max Adam Featherstonehaughs", "Staff", False),
         ("p", "Max Adam Featherstonehaughs", "Staff", False), ("q", "Ann Featherstonehaughs", "Staff", False)],
        "person_id string, full_name string, title string, is_student boolean").coalesce(1)
    names = spark.createDataFrame([(n,) for n in ("FEATHERSTONEHA, M.A.", "FEATHERSTONEHA, M.", "FEATHERSTONEHA", None)], "name string")
    got = {r.name: r.person_id for r in people.resolve_names(names, directory).collect()}
    assert got == {"FEATHERSTONEHA, M.A.": "p", "FEATHERSTONEHA, M.": "p", "FEATHERSTONEHA": None, None: None}


def test_prefixes_are_not_gathered(spark):
    names = spark.createDataFrame([("DE LA CRUZ, M.",)], "name string")
    directory = spark.createDataFrame([("c", "Maria De La Cruz", "Staff", False)], "person_id string, full_name string, title string, is_student boolean")
    plan = people.resolve_names(names, directory)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(t#" not in plan
