from cairn.operators import markup

ITEMS = "project string, item_type string, path string, text string"
SYMBOLS = "identity string, name string, semantic_name string, kind string, project string"
VIEW = '<Window x:Class="Shop.Main"\n        DataType="{x:Type vm:Basket}">\n  <local:Price Amount="{Binding Path=Item.Cost}" Clicked="OnBuy" Title="Basket" />\n  <Button BuyCommand="{Binding Buy}"/>\n</Window>'
PART = '@inject Shop.Prices prices\n<Card />\n<input @bind="Name" @onclick="@(Save)">\n<div>small</div>'


def run(spark):
    items = spark.createDataFrame([("a.csproj", "Page", "ui\\Main.xaml", VIEW), ("a.csproj", "Page", "UI/main.xaml", VIEW), ("a.csproj", "Compile", "x.cs", "<Card/>"), ("b.csproj", "Page", "Part.razor", PART), ("b.csproj", "MauiXaml", "e.xaml", None)], ITEMS)
    symbols = spark.createDataFrame(
        [("m", "Main", "Shop.Main", "class", "a.csproj"), ("k", "Basket", "Shop.Vm.Basket", "class", "a.csproj"), ("p1", "Price", "Shop.Price", "class", "b.csproj"), ("p2", "Price", "Other.Price", "record", "A.CSPROJ"), ("p3", "Price", "Odd.Price", "method", "a.csproj"),
         ("c", "Cost", "Shop.Item.Cost", "property", "a.csproj"), ("o", "OnBuy", "Shop.Main.OnBuy", "method", "a.csproj"), ("b", "Buy", "Shop.Vm.Buy", "property", "a.csproj"), ("i", "Prices", "Shop.Prices", "class", "c.csproj"), ("s", "Save", None, "method", "b.csproj"), ("n", "Name", "Shop.Name", "property", "b.csproj"),
         *[(f"card{j}", "Card", f"P{j}.Card", "class", f"p{j}.csproj") for j in range(6)]], SYMBOLS)
    return markup.markup_edges(items, symbols), items


def test_a_view_its_code_behind_and_a_component(spark):
    edges, _ = run(spark)
    got = {(r.file, r.relationship, r.target): (r.line, r.column, r.end_line, r.end_column) for r in edges.collect()}
    view = {k[1:]: v for k, v in got.items() if k[0] != "Part.razor"}
    assert view == {
        ("markup-code-behind", "m"): (1, 9, 1, 28), ("markup-data-context", "k"): (2, 9, 2, 36), ("component-use", "p2"): (3, 3, 3, 15), ("component-use", "p1"): (3, 3, 3, 15),
        ("markup-binding", "c"): (3, 16, 3, 47), ("markup-event", "o"): (3, 50, 3, 65), ("markup-command", "b"): (4, 11, 4, 35),
    }
    part = {k[1:]: v for k, v in got.items() if k[0] == "Part.razor"}
    assert part.pop(("dependency-injection", "i")) == (1, 1, 1, 27) and part.pop(("markup-binding", "n")) == (3, 8, 3, 19) and part.pop(("markup-event", "s")) == (3, 21, 3, 37)
    assert part == {("component-use", f"card{j}"): (2, 1, 2, 6) for j in range(3)}  # three of six, by project


def test_symbols_of_markup(spark):
    _, items = run(spark)
    rows = {r.file: r for r in markup.markup_symbols(markup.markup_files(items)).collect()}
    assert len(rows) == 3
    main = next(r for f, r in rows.items() if f.lower().endswith("main.xaml"))
    assert (main.kind, main.semantic_name, main.namespace, main.end_line) == ("xaml-view", "Shop.Main", "Shop", 5)
    assert (rows["Part.razor"].kind, rows["Part.razor"].namespace) == ("razor-component", None)
    assert rows["e.xaml"].semantic_name == "e"


def test_positions_over_lines_and_marks(spark):
    df = spark.createDataFrame([(1, "ab\n\u0001x = 1\nx = 22x = 3"), (2, None), (3, "x =\n\n7")], "id long, text string")
    got = markup.positions(df, ["id"], "text", {}, {5: (r"x\s*=\s*(\d)", 1)}).orderBy("id", "nth").collect()
    assert [(r.id, r.nth, r["first"], r.line, r.column, r.end_line, r.end_column) for r in got] == [(1, 1, "1", 2, 2, 2, 7), (1, 2, "2", 3, 1, 3, 6), (1, 3, "3", 3, 7, 3, 12), (3, 1, "7", 1, 1, 3, 2)]
