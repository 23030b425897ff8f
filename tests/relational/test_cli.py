import sys
import types

from tessera.__main__ import main
from tessera.schema.migrate import between
from tessera.sources.store import Store
from tessera.spec import column, model


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    m = model("things", column("id", "int"), column("name", "string"))
    module = types.ModuleType("my_things")
    module.MIGRATIONS, module.MODELS = [between("001", "first", [], [m])], [m]
    module.seed = lambda store: store.transact(lambda c: c.append("things", spark.createDataFrame([(1, "a")], m.schema())))
    monkeypatch.setitem(sys.modules, "my_things", module)
    root = str(tmp_path / "s")
    run = lambda *a: (main([*a, "--store", root]), capsys.readouterr().out.strip())
    assert run("migrate", "status", "--migrations", "my_things:MIGRATIONS") == (0, "001 first pending")
    assert run("check", "--models", "my_things:MODELS") == (1, "things: missing table")
    assert run("migrate", "up", "--migrations", "my_things:MIGRATIONS") == (0, "001")
    assert run("check", "--models", "my_things:MODELS") == (0, "")
    assert run("seed", "--run", "my_things:seed")[0] == 0 and Store(spark, root).read("things").count() == 1
    assert "things" in run("tables")[1] and run("history")[1].split("\n")[-1] == "2 things"
    assert run("migrate", "verify", "--migrations", "my_things:MIGRATIONS") == (0, "")
    assert run("adopt")[1].splitlines()[-1] == 'THINGS = model("things", column("id", T.IntegerType(), nullable=True), column("name", T.StringType(), nullable=True), key="id")'
    assert run("migrate", "down", "--migrations", "my_things:MIGRATIONS") == (0, "001") and main(["version"]) == 0
    capsys.readouterr()
    module.MIGRATIONS = [between("001", "other", [], [])]
    assert run("migrate", "adopt", "--migrations", "my_things:MIGRATIONS") == (0, "001") and "things" not in Store(spark, root).manifest().tables
    module.MIGRATIONS = []
    assert run("migrate", "verify", "--migrations", "my_things:MIGRATIONS") == (1, "001: is applied and not among the migrations")
    assert run("init", "--models", "my_things:MODELS") == (0, "things") and run("init", "--models", "my_things:MODELS") == (0, "")
    capsys.readouterr()
    for want in ("001_add_shelf.py", "002_add_shelf.py"):
        assert main(["new", "Add shelf", "--folder", str(tmp_path / "m")]) == 0 and capsys.readouterr().out.strip().endswith(want)
    scope = {}
    exec((tmp_path / "m" / "002_add_shelf.py").read_text(), scope)
    assert scope["MIGRATION"].version == "002"
