"""Each rule finds its broken rows, and null passes."""

from datetime import datetime

from fleetspark.operators import quality

AT = datetime(2024, 1, 1)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_checks(spark):
    tables = {
        "clients": spark.createDataFrame([(1, "odd"), (2, None), (3, "down")], "id int, health_status string"),
        "deleted_sites": spark.createDataFrame([(1, AT, AT), (2, AT, None)], "id int, deleted_at timestamp_ntz, recovery_deadline timestamp_ntz"),
        "registry_operations_log": spark.createDataFrame([(1, "fly", "lost"), (2, "deploy", None)], "id int, operation_type string, operation_status string"),
        "nation": spark.createDataFrame([(1,)], "id int"),
    }
    assert got(quality.check_violations(tables)) == [
        ("clients", "check_health_status", "1"), ("deleted_sites", "check_recovery_deadline", "1"),
        ("registry_operations_log", "check_operation_status", "1"), ("registry_operations_log", "check_operation_type", "1")]


def test_duplicates(spark):
    tables = {"platform_inventory": spark.createDataFrame([(1, "g", "r", "1"), (2, "g", "r", "1"), (3, None, "r", "1"), (4, None, "r", "1")],
                                                          "id int, platform string, resource_type string, resource_id string")}
    assert got(quality.duplicate_keys(tables)) == [("platform_inventory", "platform,resource_type,resource_id", "g|r|1", 2)]


def test_references(spark):
    tables = {
        "clients": spark.createDataFrame([("a",)], "id string"),
        "site_deployments": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, client_id string"),
        "registry_operations_log": spark.createDataFrame([(7, "a", 7), (8, "a", 9)], "id long, client_id string, rollback_operation_id long"),
    }
    assert got(quality.fk_orphans(tables)) == [
        ("registry_operations_log", "rollback_operation_id", "8", "9"), ("site_deployments", "client_id", "2", "b")]


def test_required(spark):
    df = spark.createDataFrame([(1, "a", None, "x", "s"), (2, None, None, "x", "s")], "id int, client_id string, commit_sha string, deployed_by string, status string")
    assert got(quality.not_null_report({"site_deployments": df}, only_violations=True)) == [
        ("site_deployments", "client_id", 1, 2), ("site_deployments", "commit_sha", 2, 2)]
