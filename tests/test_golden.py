"""Published values: distances of fixed trees, and the matrix that fifteen of them give."""

import numpy as np
import pytest

from sylvan.functions import cluster, geodesic as G, newick
from sylvan.operators import pairs, trees
from sylvan.sources import tables

# Fifteen trees of three classes.
TREES = [
    ("class1_1", "((((Sp1:1.48316688535948748573,(Sp4:1.16694627918414717271,((Sp8:0.00749288437337519448,Sp9:0.00314524716567961358):0.27378132234465857309,Sp10:0.39794653895391474130):0.78609976645141732554):1.03425340008523769519):0.23717148493240841622,(Sp2:0.86831918349601266982,Sp3:0.87606261459932210922):0.78585418662398165424):0.32818026575837505598,Sp6:0.63473594968401148009):0.10373654604107361565,Sp5:0.46428686142790226432,Sp7:0.64062209260435487579):0.0;"),
    ("class1_2", "(((Sp1:1.72896539180372643685,(Sp2:0.62185564974890694678,Sp3:0.84876015471977894755):0.78336696880805689602):0.16764263736156587159,(Sp4:1.45328919817994361985,((Sp8:0.00000092653533640432,Sp9:0.00240174579035663631):0.36122923840124931960,Sp10:0.27042346682555579163):0.68888940531319708960):1.15761955034437957757):0.36898769541387516080,(Sp5:0.53034617496153169114,Sp7:0.67743836572577131871):0.22968712406034999529,Sp6:0.39471318913611869172):0.0;"),
    ("class1_3", "((((Sp1:1.70341357993592046327,(Sp2:1.00476950629449279795,Sp3:0.78079604242511380097):0.95879260319246772948):0.20411967218509247113,(Sp4:1.06305589720649051877,((Sp8:0.00717919882458552001,Sp9:0.00000096250690437580):0.16079511684716446540,Sp10:0.45546648338734085915):0.76408650116144993802):1.31811492944763064550):0.37769805239637316285,Sp6:0.27995064744773234811):0.25169928397869301140,Sp5:0.59408334035946797069,Sp7:0.66090523452752225619):0.0;"),
    ("class1_4", "(((Sp4:0.98308007580767131639,((Sp8:0.00731146436177694970,Sp9:0.00550887644390888991):0.38095373245191110900,Sp10:0.29768484659277799631):0.75228076385065334453):1.32972160544470741073,(Sp1:1.79504509078912644071,(Sp2:0.80206592161149670162,Sp3:0.69815002005043180766):0.85902245720456282818):0.06200971395278900844):0.33741038955747792993,(Sp5:0.49059254811333113944,Sp7:0.71305775788786907032):0.19014539256097939823,Sp6:0.42163076476654781644):0.0;"),
    ("class1_5", "(((Sp1:1.39030464719550717057,((Sp2:0.86952078778468522291,Sp3:0.74473743861875107974):0.82547846878143593674,((Sp5:0.58212146375972073642,Sp7:0.65887169686190460993):0.16758253218531804496,Sp6:0.59091039691347535534):0.49558453833294846547):0.00000092449553275590):0.82001205893502249200,Sp4:1.14757027884123408157):0.88182387253374305836,(Sp8:0.00000092449553275590,Sp9:0.01346467023269313536):0.45934284851187950904,Sp10:0.17544631724801210138):0.0;"),
    ("class2_1", "((((Sp1:1.51263818054393417434,(Sp2:0.89016309863330633778,Sp3:0.66288161178039695098):0.60163140160713601823):1.25830859842532793991,(Sp8:0.00352431739577615524,Sp9:0.00000093012993242713):0.21396463282527544703):0.97673988347653728503,((Sp5:0.50992518420334287388,Sp7:0.62980717931647256513):0.23096727639158479151,Sp6:0.53565515052823620135):0.42034497773240203644):0.06576252253023023853,Sp4:1.09432884738901181620,Sp10:0.41745708618555932290):0.0;"),
    ("class2_2", "((((Sp1:1.74956530436409685159,(Sp2:0.94506267645470631855,Sp3:0.83420396245685479730):0.91008837819415366877):1.51826779267617539837,(Sp8:0.00000094819242958338,Sp9:0.00441621701202833152):0.42899894107678993027):0.75125881234377123175,((Sp5:0.47437611773884041932,Sp7:0.71878433820629872297):0.27922142880639211349,Sp6:0.55994636345651038756):0.31224322359550743533):0.10949691563368040004,Sp4:1.26055692974118294103,Sp10:0.27224165615297557519):0.0;"),
    ("class2_3", "((((Sp1:1.46865947479751035587,(Sp2:0.91475299333124049372,Sp3:0.83730110853152306394):0.91634081474940065615):0.95877984185825737562,(Sp8:0.00000096189398877375,Sp9:0.00000096189398877375):0.30381237048725312500):0.90965754519763064589,((Sp5:0.42738974205712282339,Sp7:0.76753587737656092660):0.20862023039341079378,Sp6:0.48928992532553639005):0.52579503994267728917):0.05354330658630893774,Sp4:1.58748906227098141031,Sp10:0.30820615505981946436):0.0;"),
    ("class2_4", "(((((Sp1:1.45411450414886123106,(Sp2:0.92557026512806173102,Sp3:0.73926266736101964305):0.88548210731743115520):1.11004237123604854176,(Sp8:0.00000092925865510874,Sp9:0.00000092925865510874):0.34419718487667788631):0.73510175879896733075,Sp10:0.34320788710221128426):0.00000092925865510874,Sp4:0.96102283284501799354):0.51006358159784281892,(Sp5:0.54860776278127976191,Sp7:0.68119032565463644158):0.25467197875161229348,Sp6:0.39369910297435090074):0.0;"),
    ("class2_5", "((((Sp1:1.07654658465342678575,(Sp2:0.81345609798828610870,Sp3:0.63822995255964443118):0.71571241995465828545):1.39028106228784809062,(Sp8:0.00000090241608950520,Sp9:0.00000090241608950520):0.33470004198552344432):0.72863469260557489626,((Sp5:0.39838594827689571831,Sp7:0.54265013281798124556):0.29636756688067106280,Sp6:0.41700467952591385723):0.38614610888060346694):0.18098330769544321295,Sp4:0.92223255882683785600,Sp10:0.35260789268304837396):0.0;"),
    ("class3_1", "((((((Sp1:1.19609014137980040893,Sp2:0.98402055476723782057):0.72331261840450311595,Sp3:1.05686266482855484306):1.06515665050320484930,((Sp8:0.00000094584547442304,Sp9:0.00000094584547442304):0.41142836726812881398,Sp10:0.34384669795653355351):0.64069163478824742164):0.06312332125005515326,Sp4:1.08618165909874897501):0.43653717150960752447,Sp5:0.41236659282392623682):0.34604389232173482505,Sp6:0.31830062777236900473,Sp7:0.62545465089308771578):0.0;"),
    ("class3_2", "(((((Sp1:1.53384770667477421391,Sp2:0.81156401075183992599):0.61308724945055514954,Sp3:0.96321599429816751048):1.17273897731574261449,(Sp5:0.43361195052846307485,(Sp6:0.56697639657072007591,Sp7:0.57806582959029428892):0.20038434321485537604):0.37921298700496858247):0.06460196585329264218,Sp4:0.90101623756599569237):0.98372749664907810363,(Sp8:0.00463933098466853995,Sp9:0.00000093251788412419):0.32962052872349140165,Sp10:0.36989571301354734478):0.0;"),
    ("class3_3", "(((((Sp1:1.00355672296358666706,Sp2:1.11367204269106667702):0.89838801811573187894,Sp3:0.28959435691969226401):1.06077359765386147750,(Sp4:1.26445193602458205717,((Sp8:0.00000092290028340589,Sp9:0.00000092290028340589):0.23108378993960668191,Sp10:0.38344284478609652611):0.59250512559614010311):0.00000092290028340589):0.58151512382710046634,Sp5:0.50485835162852010782):0.17728774822044998660,Sp6:0.52208907184909270072,Sp7:0.69420631956285483444):0.0;"),
    ("class3_4", "(((((Sp1:1.57913209222466344173,Sp2:0.86732564154241542642):0.73303292878448822467,Sp3:0.94654741735253777879):1.11590517541169664817,(Sp4:1.16628149177816187176,((Sp8:0.00698738973388475949,Sp9:0.00071321724306133813):0.37802613181919780816,Sp10:0.32238999245174182473):0.91573986143190799769):0.04884538557595706487):0.39137246179932444479,Sp5:0.45618356366191342710):0.19880334036508837126,Sp6:0.44044913160186421885,Sp7:0.67264016852183816653):0.0;"),
    ("class3_5", "(((((Sp1:1.50975104668219883841,Sp2:1.43395844902791314013):0.80160236364630077510,Sp3:0.81089434324897158302):0.81338916432057373207,(Sp4:1.54132663031770777984,((Sp8:0.02157851013954640088,Sp9:0.00000092764811104043):0.32335397358057021977,Sp10:0.23279386663649448419):0.85100254097377980855):0.04131542422201774090):0.46858420620347107644,Sp5:0.48053101282657323390):0.00000092764811104043,Sp6:0.46611831606545028883,Sp7:0.50922995703828743963):0.0;"),
]
# Distances of the first two trees, as they are and normalised, and the sum of the square matrix of geodesics.
GOLDEN = {
    ("geo", False): 0.7051762453884542, ("geo", True): 0.11511918913951155, ("euc", False): 0.6463384798834909, ("euc", True): 0.10551399341715575,
    ("wrf", False): 2.1666480728499717, ("wrf", True): 0.1063259354618597, ("rf", False): 2.0, ("rf", True): 0.14285714285714285,
}
MATRIX_SUM, PARTIAL = 412.70677069540181, 0.35314280333144532


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TREES)], "tree_id long, newick string")


@pytest.fixture(scope="module")
def geodesics(table):
    return trees.tree_distances(table, "geo").toPandas()


@pytest.mark.parametrize("metric,normalise", sorted(GOLDEN))
def test_distance_of_the_first_two(table, metric, normalise):
    d = trees.tree_distances(table.where("tree_id < 2"), metric, normalise).first()["d"]
    assert abs(d - GOLDEN[metric, normalise]) < 1e-9


@pytest.mark.parametrize("metric", ["rf", "wrf", "euc"])
def test_joined_splits_give_what_one_pair_at_a_time_gives(table, metric):
    """The path over shared splits, and the one over pairs of trees, which trees on different leaves take."""
    parsed = [newick.splits(newick.parse(t)) for _, t in TREES]
    for normalise in (False, True):
        out = {(r["i"], r["j"]): r["d"] for r in trees.tree_distances(table, metric, normalise).collect()}
        assert len(out) == 105
        for (i, j), d in out.items():
            assert abs(d - trees.METRICS[metric](parsed[i], parsed[j], 10, normalise)) < 1e-9


def test_matrix_of_all_fifteen(geodesics):
    assert len(geodesics) == 105 and abs(2 * geodesics["d"].sum() - MATRIX_SUM) < 1e-9


def test_matrix_through_a_file(spark, table, tmp_path):
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(TREES)], "i long, name string")
    dm = trees.tree_distances(table, "geo")
    tables.write_distances(pairs.full(dm, names.select(names.i.alias("node"))), names, str(tmp_path / "dm"))
    back, labels = tables.read_distances(spark, str(tmp_path / "dm"))
    assert abs(2 * back.groupBy().sum("d").first()[0] - MATRIX_SUM) < 1e-9
    assert [r["name"] for r in labels.orderBy("i").collect()] == [n for n, _ in TREES]


def test_partial_overlap(spark):
    """Seven leaves each, four of them shared."""
    leaves = [{f"Sp{k}" for k in range(1, 8)}, {f"Sp{k}" for k in range(4, 11)}]
    rows = [(k, newick.write(newick.restricted(newick.parse(TREES[k][1]), leaves[k]))) for k in range(2)]
    table = spark.createDataFrame(rows, "tree_id long, newick string")
    assert abs(trees.tree_distances(table, "geo").first()["d"] - PARTIAL) < 1e-9
    assert trees.tree_distances(table, "geo", min_overlap=5, fail_value=-1.0).first()["d"] == -1
    assert trees.tree_distances(table, "rf", min_overlap=5, fail_value=-1.0).first()["d"] == -1


def test_embeddings_and_clusters_of_the_matrix(geodesics):
    """Shapes of all embeddings in three dimensions; every method finds the three classes."""
    d = np.zeros((15, 15))
    d[geodesics["i"], geodesics["j"]] = d[geodesics["j"], geodesics["i"]] = geodesics["d"]
    for method in ("cmds", "kpca", "spectral", "mmds", "nmmds"):
        assert cluster.embedding(d, 3, method).shape == (15, 3)
    truth = [0] * 5 + [1] * 5 + [2] * 5
    for linkage in cluster.LINKAGES:
        assert cluster.flat(cluster.linkage(d, linkage), 15, 3) == truth
    assert cluster.spectral_clusters(d, 3, seed=1) == truth and cluster.scaling_clusters(d, 3, seed=1) == truth and cluster.kmedoids(d, 3, 1)[0] == truth


def test_a_tree_is_at_no_distance_from_itself():
    s = newick.splits(newick.parse(TREES[0][1]))
    assert G.geodesic(s, dict(s)) == 0 == G.euclidean(s, dict(s)) == G.weighted_rf(s, dict(s)) == G.robinson_foulds(s, dict(s), 10)
